"""Exact quantiles and top shares of each sequence, without a window or a map over all its values.

A sketch of ``GRID`` percentiles brackets the places that are asked for. Values between the brackets are only counted;
those inside, a few per mille of all, are counted one by one, ties together, and numbered. So neither a long sequence nor
one value that most rows share meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.session import durable

#: Steps of the sketch, and its accuracy; the brackets reach beyond a place by five times its error or more.
GRID, ACCURACY = 500, 2_500


def sketch(values: DataFrame) -> DataFrame:
    """(video_id, n, grid) of (video_id, value): how many values there are, and about where their percentiles lie."""
    grid = F.percentile_approx("value", [i / GRID for i in range(GRID + 1)], ACCURACY)
    return values.where("value is not null").groupBy("video_id").agg(F.count("*").alias("n"), grid.alias("grid"))


def at_places(values: DataFrame, places: dict[str, Column], extra: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(video_id, n, and for each name in ``places`` its value and ``<name>_above``) of (video_id, value).

    A place is a number from 0 to n - 1, an expression of n and the columns of ``extra`` (one row a video); between two
    neighbours in order the value is interpolated. ``above`` counts the values greater than the lower neighbour. Null values
    are passed over. Videos that ``extra`` lacks are left out. ``known``: the ``sketch`` of the values, if there is one.
    """
    names = list(places)
    values = values.where("value is not null")
    about = sketch(values) if known is None else known
    if extra is not None:
        about = about.join(extra.drop("n"), "video_id")
    about = about.select("video_id", "n", "grid", *[F.round(places[p], 9).alias(f"__p{k}") for k, p in enumerate(names)])

    def edge(k: int, up: bool) -> Column:
        place = F.col(f"__p{k}")  # the i-th of n values, from 0, is their (i + 1) / n percentile
        at = F.ceil((F.ceil(place) + 1) * GRID / F.col("n")) + 1 if up else F.floor((F.floor(place) + 1) * GRID / F.col("n")) - 2
        return F.get("grid", F.greatest(F.lit(0), F.least(F.lit(GRID), at)).cast("int"))

    brackets = about.select("video_id", "n", *[f"__p{k}" for k in range(len(names))], F.array(*[F.struct(edge(k, False).alias("lo"), edge(k, True).alias("hi")) for k in range(len(names))]).alias("b"))
    v = F.col("value")
    inside = F.exists("b", lambda x: (v >= x["lo"]) & (v <= x["hi"]))
    below = F.array_max(F.transform(F.filter("b", lambda x: x["hi"] < v), lambda x: x["hi"]))
    marked = values.join(brackets.select("video_id", "b"), "video_id").select("video_id", inside.alias("single"), F.when(inside, v).otherwise(below).alias("key"))
    counts = marked.groupBy("video_id", "key", "single").agg(F.count("*").alias("c"))
    order = Window.partitionBy("video_id").orderBy(F.col("key").asc_nulls_first(), F.col("single").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("c").over(order)).where("single").join(brackets.drop("b"), "video_id")
    found = []
    for k, p in enumerate(names):
        place = F.col(f"__p{k}")
        lower, upper = F.floor(place), F.ceil(place)
        holds = lambda i: (F.col("upto") > i) & (F.col("upto") - F.col("c") <= i)
        low, high = F.max(F.when(holds(lower), F.col("key"))), F.max(F.when(holds(upper), F.col("key")))
        part = F.first(place - lower)
        value = F.coalesce(low + (high - low) * part, F.raise_error(F.lit(f"{p}: the place lies outside its bracket")).cast("double"))
        found.append(value.alias(p))
        found.append((F.first("n") - F.max(F.when(holds(lower), F.col("upto")))).alias(f"{p}_above"))
    return upto.groupBy("video_id").agg(F.first("n").alias("n"), *found)


def quantiles(values: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """(video_id, n, and each named quantile) of (video_id, value), linear between neighbours."""
    out = at_places(values, {name: (F.col("n") - 1) * q for name, q in fractions.items()})
    return out.select("video_id", "n", *fractions)


def top_rows(rows: DataFrame, counts: DataFrame, known: DataFrame | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` (video_id, frame_idx, score, ..) of the ``k`` greatest scores of each video, by ``counts`` (video_id, k, ..), with counts' other columns.

    Of rows that tie at the cut the first by frame_idx are taken; only these are ranked. ``more``: values at other places,
    as ``at_places`` gives them, as further columns.
    """
    cut = {"cut": F.greatest(F.least(F.col("n") - F.col("k"), F.col("n") - 1), F.lit(0)), **(more or {})}
    found = at_places(rows.select("video_id", F.col("score").alias("value")), cut, counts, known)
    plan = durable(counts.join(found.select("video_id", "cut", "cut_above", *(more or {})), "video_id"))  # one row a video
    near = rows.join(plan, "video_id").where((F.col("score") >= F.col("cut")) & (F.col("k") > 0))
    own = [c for c in near.columns if c not in ("cut", "cut_above")]
    tied = near.where(F.col("score") == F.col("cut")).withColumn("nth", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx")))
    return near.where(F.col("score") > F.col("cut")).select(*own).unionAll(tied.where(F.col("nth") <= F.col("k") - F.col("cut_above")).select(*own))
