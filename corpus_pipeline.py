"""The corpus pipeline: documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a DataFrame; the
result is written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.

Defined cases, in every stage: null and empty texts are documents like any other (not toxic, copies of each other, not
contaminated, packed as the end token alone). Null and repeated doc_ids don't matter, as rows are told apart by their
address; a null id ranks below every other where ids decide which copy stays. Extra columns are carried along, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from strandmill.llm.common import durable, remove, table
from strandmill.session import shared_folder, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    ship_package(spark)
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one document, that with the smallest doc_id."""
    ship_package(spark)
    return near_dedup.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no near copy of a benchmark item."""
    ship_package(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    ship_package(spark)
    return packing.pack(docs, added=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents. What lies between them is written to the cluster's shared folder and removed when it has been read."""
    docs, here = table(spark, sf_dir, "documents"), f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{here}/{k}")
            docs = spark.read.parquet(f"{here}/{k}")
            if k:
                remove(spark, f"{here}/{k - 1}")
        return durable(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        remove(spark, here)


#: The classifier, the walk and the tokenizer have no SQL form; tests/llm/test_pipeline.py checks run() stage by stage.
ORACLE_SQL: str | None = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
