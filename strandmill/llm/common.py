"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill import session

#: A key with more than 1/HOT_SHARE of all rows is joined by broadcast, and one with more than HOT_ROWS rows too, as long
#: as there can't be more than HOT_KEYS of these.
HOT_SHARE, HOT_ROWS, HOT_KEYS = 1000, 1_000_000, 20_000

#: Row addresses (two longs each) that are broadcast at most; above that they meet their rows in a shuffle.
BROADCAST_ROWS = 500_000

#: Rows of an Arrow batch that goes to a Python worker; bounds memory for long texts.
ARROW_ROWS = 1000

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: lower-cases A-Z only, so any UTF-8 sequence stays valid.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ARROW_ROWS rows. Set once and left, so that queries don't disturb each other."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(size)) <= ARROW_ROWS:
        spark.conf.set(size, str(ARROW_ROWS))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """Materialise in the cluster's shared checkpoint folder, so a lost executor costs no recomputation."""
    small_batches(df.sparkSession)
    return session.durable(df)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as make it differ from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a Parquet scan with nothing but filters and projections above it."""
    plan = df._jdf.queryExecution().analyzed()
    while (kind := plan.getClass().getSimpleName()) in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if kind != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    named = [plan.output().apply(k).name().lower() for k in range(plan.output().size())]
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat" and "_metadata" not in named


def addressed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(``docs`` with two long columns that name each row, alike at every reading; their names).

    For a Parquet scan they are the hash of the file's path and the row's place in the file, which cost nothing. Anything
    else is made durable first, and its rows are numbered. Null and repeated ids don't matter to an address.
    """
    names = fresh(docs, "file", "at")
    if _is_scan(docs):
        parts = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
    else:
        docs, parts = durable(docs), (F.lit(0).cast("long"), F.monotonically_increasing_id())
    return docs.select("*", *[p.alias(n) for p, n in zip(parts, names)]), names


def meet(rows: DataFrame, facts: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join of addressed rows with at most one row of ``facts`` an address.

    ``facts`` of at most BROADCAST_ROWS rows are broadcast, so that the rows (their texts) stay where they are. More meet
    them in a shuffle by address, which has no hot keys.
    """
    facts = durable(facts)
    return rows.join(F.broadcast(facts) if facts.count() <= BROADCAST_ROWS else facts, keys, how)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def hot_limit(total: int) -> float:
    """Keys with more rows than this, of ``total``, are hot; by arithmetic there are fewer than HOT_SHARE or HOT_KEYS of them."""
    return min(total / HOT_SHARE, max(HOT_ROWS, total / HOT_KEYS))


def join_facts(left: DataFrame, facts: DataFrame, keys: list[str], weight: str, total: int, spread: Column) -> DataFrame:
    """Left join of many rows with one row of facts a key, safe if one key holds most rows of ``left``.

    ``weight`` is the fact column with the number of left rows of the key and ``total`` their sum. The keys above
    ``hot_limit`` are broadcast. All others go through a shuffle, in which the rows that are already answered are spread
    by ``spread`` instead of meeting in one task. ``keys`` must not be null on either side. ``weight`` is dropped.
    """
    names = [c for c in facts.columns if c not in (*keys, weight)]
    is_hot = F.col(weight) > F.lit(hot_limit(total))
    hot = facts.where(is_hot).select(*keys, *[F.col(c).alias(f"__h_{c}") for c in names], F.lit(True).alias("__hot"))
    cold = facts.where(~is_hot).select(*keys, *[F.col(c).alias(f"__c_{c}") for c in names], F.lit(0).alias("__salt"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(1 << 16)).cast("int") + 1).otherwise(F.lit(0))
    kept = left.columns
    both = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).join(cold, [*keys, "__salt"], "left")
    return both.select(*kept, *[F.when(F.col("__hot"), F.col(f"__h_{c}")).otherwise(F.col(f"__c_{c}")).alias(c) for c in names])


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of undirected edges (a long, b long) as (node, component), the smallest node naming each.

    Alternates large-star and small-star steps until the edges stand still; every round is checkpointed. Nodes of
    high degree are joined by ``join_facts``. Only nodes with an edge to another node are returned.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(e: DataFrame) -> tuple:
        x = e.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.lit(0))).first()
        return int(x[0]), int(x[1])

    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # large star: every larger neighbour of u goes to the smallest node among u and its neighbours
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")).withColumn("m", F.least("u", "m")))
        large = join_facts(both, least, ["u"], "w", 2 * seen[0], F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.where("u <> v").distinct())
        # small star: u and its smaller neighbours go to the smallest of them; u > v holds in every edge
        least = durable(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")))
        n = large.count()
        joined = join_facts(large, least, ["u"], "w", n, F.col("v"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now, before = durable(small), seen
        seen = mark(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
