"""Exact deduplication by content-defined chunk recipes.

Every text is cut where a rolling hash of its last bytes says so, which depends on content only. The chunks are
deduplicated into a dictionary of 64-bit identifiers that are verified by SHA-256: if one identifier stands for two
digests, the digests themselves become the identifiers. A document is then its recipe, the ordered identifier list, and
two documents are equal when their recipes are. Texts are read once and never shuffled.

Defined cases: a null text counts as empty, and the empty text has the empty recipe, so all such rows form one group. A
null doc_id ranks below every other; of rows with equal doc_id and text the one with the largest address is kept. Extra
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import LOWER_TABLE, addressed, durable, join_facts, meet

#: Chunk sizes in bytes: a cut is looked for after MIN_CHUNK, is likely every 2**AVERAGE_BITS, and is forced at MAX_CHUNK.
MIN_CHUNK, AVERAGE_BITS, MAX_CHUNK = 1024, 12, 16384
#: Bytes whose hashes are computed at once; bounds memory for very long texts.
BLOCK = 1 << 20

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, the last one its length; none for empty data."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    mask, found = np.uint32(((1 << AVERAGE_BITS) - 1) << (32 - AVERAGE_BITS)), []
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, n, BLOCK):
        lead = min(at, 31)
        h = _GEAR[raw[at - lead : at + BLOCK]]
        for step in (1, 2, 4, 8, 16):  # h[i] = sum of gear[i - j] << j over the last 32 bytes, by doubling
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        found.append(np.flatnonzero((h[lead:] & mask) == 0) + at + 1)
    cuts, ends, last = np.concatenate(found), [], 0
    while n - last > MIN_CHUNK:
        i = int(np.searchsorted(cuts, last + MIN_CHUNK))
        end = min(int(cuts[i]) if i < len(cuts) else n, last + MAX_CHUNK, n)
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def _recipes(batches):
    for batch in batches:
        shas, ids, digests = [], [], []
        for text in batch.column(batch.num_columns - 1):
            data = b"" if text is None else text.as_buffer()
            data = bytes(data if data is not None else b"").translate(LOWER_TABLE)
            shas.append(hashlib.sha256(data).hexdigest())
            parts, last = [], 0
            for end in cut_points(data):
                parts.append(data[last:end])
                last = end
            ids.append([xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in parts])
            digests.append([hashlib.sha256(p).digest() for p in parts])
        made = [pa.array(shas, pa.string()), pa.array(ids, pa.list_(pa.int64())), pa.array(digests, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "text_sha256", "ids", "digests"])


def recipes(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, text_sha256, ids, digests) of each row of (doc_id, text), and in front the long columns ``carry`` as row0, row1, ..."""
    rows = [F.col(c).alias(f"row{k}") for k, c in enumerate(carry or [])]
    schema = "".join(f"row{k} long, " for k in range(len(rows))) + "doc_id long, text_sha256 string, ids array<long>, digests array<binary>"
    return docs.select(*rows, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_recipes, schema)


def dictionary(recipe_rows: DataFrame) -> DataFrame:
    """(id, uses, verified) of every distinct chunk: verified is false if one id stands for several digests.

    The digest is compared as four longs, so that equal chunks, however many, are merged before the shuffle.
    """
    chunks = recipe_rows.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select(F.col("c.ids").alias("id"), F.hex("c.digests").alias("d"))
    words = [F.conv(F.substring("d", 1 + 16 * k, 15), 16, 10).cast("long").alias(f"w{k}") for k in range(4)]
    tail = F.conv(F.concat(*[F.substring("d", 16 + 16 * k, 1) for k in range(4)]), 16, 10).cast("long").alias("w4")
    found = chunks.select("id", *words, tail).groupBy("id").agg(F.count("*").alias("uses"), *[f(f"w{k}").alias(f"{n}{k}") for k in range(5) for n, f in (("lo", F.min), ("hi", F.max))])
    same = F.lit(True)
    for k in range(5):
        same = same & (F.col(f"lo{k}") == F.col(f"hi{k}"))
    return found.select("id", "uses", same.alias("verified"))


def _grouped(rows: DataFrame, names: list[str]) -> DataFrame:
    """The recipe rows with keep_id, group_size and kept; the long columns ``names`` tell rows apart."""
    clash = dictionary(rows).where(~F.col("verified")).limit(1).count() > 0
    rows = rows.select("doc_id", "text_sha256", *names, F.col("digests" if clash else "ids").alias("recipe"))
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("doc_id"), *names)).alias("best")
    groups = rows.groupBy("recipe").agg(F.count("*").alias("w"), best).select("recipe", "w", F.col("w").alias("group_size"), "best")
    groups = durable(groups)
    total = groups.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    out = join_facts(rows, groups, ["recipe"], "w", total, F.xxhash64(*names))
    same = F.lit(True)
    for n in names:
        same = same & (F.col(n) == F.col(f"best.{n}"))
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", same.alias("kept"), "text_sha256", *names)


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs`` (doc_id, text)."""
    rows = durable(recipes(docs)).withColumn("rid", F.monotonically_increasing_id())
    return _grouped(rows, ["rid"]).drop("rid")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when of equal texts the largest doc_id is kept: one row of each group.

    The rows that go are found by their addresses, so texts stay where they are (see ``common.meet``).
    """
    rows, names = addressed(docs)
    found = _grouped(durable(recipes(rows, names)), ["row0", "row1"])
    gone = found.where(~F.col("kept")).select(*[F.col(f"row{k}").alias(n) for k, n in enumerate(names)])
    return meet(rows, gone, names, "left_anti").drop(*names)
