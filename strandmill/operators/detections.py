"""Detections over time: carry-forward, rolling class counts and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.vocabulary import RARE_CLASSES, class_name
from strandmill.operators.windows import frame_window

RARE_FACTOR = 1.25


def carry_forward(frames: DataFrame, interval: int, reuse: bool = True) -> DataFrame:
    """class_ids of every frame, detected at every ``interval``-th frame and reused until the next.

    A detection without objects is an empty array and is carried too. Each stretch of ``interval`` frames stands for
    itself, so the window's partitions are small.
    """
    fresh = F.when(F.col("frame_idx") % interval == 0, F.col("class_ids"))
    none = F.array().cast("array<int>")
    if not reuse:
        return frames.withColumn("class_ids", F.coalesce(fresh, none))
    stretch = frames.withColumn("__stretch", F.floor(F.col("frame_idx") / interval)).withColumn("__fresh", fresh)
    held = F.first("__fresh", ignorenulls=True).over(frame_window("__stretch").rowsBetween(Window.unboundedPreceding, 0))
    return stretch.withColumn("class_ids", F.coalesce(held, none)).drop("__stretch", "__fresh")


def weight_of(count: Column, name: Column, rare=RARE_CLASSES) -> Column:
    return 1.0 / F.log(count + F.lit(2.0)) * F.when(name.isin(*rare), F.lit(RARE_FACTOR)).otherwise(F.lit(1.0))


def class_weights(frames: DataFrame, observe_interval: int = 10, window: int = 60, rare=RARE_CLASSES) -> DataFrame:
    """(video_id, frame_idx, class_weight) of (video_id, frame_idx, class_ids).

    Every ``observe_interval``-th frame is an observation; a class counts as often as the last ``window`` observations,
    the current one included, show it. A frame weighs as its weightiest class, or 1 without objects. One window over
    (video, class) and one aggregation: frames between observations take part with count 0.
    """
    one = frames.select("video_id", "frame_idx", F.floor(F.col("frame_idx") / observe_interval).cast("long").alias("obs"), F.explode("class_ids").alias("class_id"))
    one = one.groupBy("video_id", "frame_idx", "obs", "class_id").agg(F.count("*").alias("n"))
    counted = F.when(F.col("frame_idx") % observe_interval == 0, F.col("n")).otherwise(F.lit(0))
    recent = Window.partitionBy("video_id", "class_id").orderBy("obs").rangeBetween(-(window - 1), 0)
    each = one.withColumn("seen", counted).withColumn("count", F.sum("seen").over(recent))
    best = each.groupBy("video_id", "frame_idx").agg(F.max(weight_of(F.col("count"), class_name(F.col("class_id")), rare)).alias("class_weight"))
    return frames.select("video_id", "frame_idx").join(best, ["video_id", "frame_idx"], "left").withColumn("class_weight", F.coalesce("class_weight", F.lit(1.0)))
