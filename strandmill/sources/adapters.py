"""The engine's tables, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIDEO_FRAMES = 100
GRID_FRAMES = 720
#: Hours from the epoch to 2024-01-01.
FIRST_HOUR = 473352
#: Class of each event type, as numbered in ``vocabulary.CLASSES``.
EVENT_CLASS = {"click": 2, "error": 1, "purchase": 8, "signup": 3, "view": 9}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doubles(col: str | Column) -> Column:
    return F.col(col).cast("array<double>") if isinstance(col, str) else col.cast("array<double>")


def features(spark: SparkSession, sf_dir: str, per_video: int = VIDEO_FRAMES) -> DataFrame:
    """(video_id, frame_idx, feat): embeddings in videos of ``per_video`` frames."""
    e = table(spark, sf_dir, "embeddings")
    video = F.concat(F.lit("v"), F.floor(F.col("vec_id") / per_video).cast("string"))
    return e.select(video.alias("video_id"), (F.col("vec_id") % per_video).cast("int").alias("frame_idx"), doubles("embedding").alias("feat"))


def gray_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_idx, px): 8 x 8 gray pixels, row by row, from each feature vector."""
    gray = F.transform("feat", lambda x: F.floor((F.greatest(F.least(x * 4, F.lit(1.0)), F.lit(-1.0)) + 1) * 127.5).cast("int"))
    return features(spark, sf_dir).select("video_id", "frame_idx", gray.alias("px"))


def colours(px: str = "px") -> Column:
    """Array of 64 struct(b, g, r): the gray pixels read three times, the second and third time from a third and two thirds on."""
    at = lambda i: F.get(px, (i % 64).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(at(i).alias("b"), at(i + 21).alias("g"), at(i + 42).alias("r")))


def colour_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_idx, height, width, n_channels, data): 8 x 8 BGR pictures."""
    flat = F.flatten(F.transform(colours(), lambda c: F.array(c["b"], c["g"], c["r"])))
    data = F.unhex(F.array_join(F.transform(flat, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    size = [F.lit(n).alias(c) for n, c in ((8, "height"), (8, "width"), (3, "n_channels"))]
    return gray_frames(spark, sf_dir).select("video_id", "frame_idx", *size, data.alias("data"))


def label_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_idx, labels): 8 x 8 label maps, 0 for no edge and 1 to 7."""
    label = F.transform("px", lambda v: F.greatest(F.lit(0), F.floor((v - 96) / 20)).cast("int"))
    return gray_frames(spark, sf_dir).select("video_id", "frame_idx", label.alias("labels"))


def detection_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_idx, class_ids, level): the dense frame grid with what an hour's events show; level is their mean value."""
    class_of = F.create_map(*[x for k, v in EVENT_CLASS.items() for x in (F.lit(k), F.lit(v))])
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("v"), (F.col("user_id") % 10).cast("string")).alias("video_id"),
        (F.floor(F.unix_timestamp("ts") / 3600) - FIRST_HOUR).cast("int").alias("frame_idx"),
        class_of[F.col("event_type")].alias("class_id"),
        "value",
    )
    seen = e.groupBy("video_id", "frame_idx").agg(F.sort_array(F.collect_list("class_id")).alias("class_ids"), F.round(F.avg("value"), 6).alias("level"))
    grid = e.select("video_id").distinct().select("video_id", F.explode(F.sequence(F.lit(0), F.lit(GRID_FRAMES - 1))).alias("frame_idx"))
    both = grid.join(seen, ["video_id", "frame_idx"], "left")
    return both.select("video_id", "frame_idx", F.coalesce("class_ids", F.array().cast("array<int>")).alias("class_ids"), F.coalesce("level", F.lit(0.0)).alias("level"))


def grid_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_idx, feat) for the detection grid: vectors dealt out in turn."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), doubles("embedding").alias("feat"))
    n = e.agg(F.count("*").alias("n"))
    grid = table(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("long").alias("v")).distinct()
    grid = grid.select("v", F.explode(F.sequence(F.lit(0), F.lit(GRID_FRAMES - 1))).alias("frame_idx")).join(F.broadcast(n))
    grid = grid.select(F.concat(F.lit("v"), F.col("v").cast("string")).alias("video_id"), "frame_idx", ((F.col("v") * GRID_FRAMES + F.col("frame_idx")) % F.col("n")).alias("vec_id"))
    return grid.join(e, "vec_id").select("video_id", "frame_idx", "feat")


def price_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_idx, score): line items as scored frames, a video a supplier bucket."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.concat(F.lit("v"), (F.col("l_suppkey") % 8).cast("string")).alias("video_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("frame_idx"), (F.col("l_extendedprice") / 100000.0).alias("score"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, fps, frame_count, size_bytes): documents as files."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("video_id"), (F.col("doc_id") % 40).cast("double").alias("fps"), (F.col("n_chars") % 1000).alias("frame_count"), F.col("n_chars").alias("size_bytes"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_idx, class_id, conf, box, det): line items as detections; a video a ship year, a frame a day."""
    x = table(spark, sf_dir, "lineitem")
    cx, cy, half = (F.col("l_partkey") % 640).cast("double"), (F.col("l_suppkey") % 360).cast("double"), F.col("l_quantity") / 2 + 8
    box = F.struct((cx - half).alias("x1"), (cy - half).alias("y1"), (cx + half).alias("x2"), (cy + half).alias("y2"))
    return x.select(
        F.year("l_shipdate").cast("string").alias("video_id"),
        F.dayofyear("l_shipdate").alias("frame_idx"),
        (F.col("l_linenumber") % 10).cast("int").alias("class_id"),
        (F.col("l_discount") * 5 + 0.2).alias("conf"),
        box.alias("box"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("det"),
    )
