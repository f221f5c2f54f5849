"""Comparison samplers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators import context, scoring, selection
from strandmill.operators.windows import chunked, history
from strandmill.session import durable


def entropy(frames: DataFrame) -> DataFrame:
    """(video_id, frame_idx, entropy): bits of the 64-bin gray histogram, counted within the row as lengths of runs of equal bins."""
    rows = frames.select("video_id", "frame_idx", F.array_sort(F.transform("px", lambda v: F.floor(v / 4).cast("int"))).alias("bins")).withColumn("n", F.size("bins"))
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (F.get("bins", i) != F.get("bins", i - 1)))
    counts = F.zip_with("starts", F.concat(F.slice("starts", 2, F.size("starts")), F.array("n")), lambda a, b: b - a)
    held = rows.withColumn("starts", starts).withColumn("counts", F.array_sort(counts))
    p = lambda c: c / F.col("n")
    return held.select("video_id", "frame_idx", F.aggregate("counts", F.lit(0.0), lambda acc, c: acc - p(c) * F.log2(p(c) + 1e-12)).alias("entropy"))


def change(frames: DataFrame) -> DataFrame:
    """(video_id, frame_idx, motion): mean absolute gray change in levels, 0 at first."""
    return scoring.pixel_motion(frames, scale=1.0, first=0.0)


def non_uniform_scores(frames: DataFrame, weight: float = 0.6) -> DataFrame:
    """(video_id, frame_idx, score): motion and entropy, each against the video's largest."""
    both = change(frames).join(entropy(frames), ["video_id", "frame_idx"])
    most = both.groupBy("video_id").agg(F.max("motion").alias("m"), F.max("entropy").alias("e"))
    score = weight * F.col("motion") / (F.col("m") + 1e-8) + (1 - weight) * F.col("entropy") / (F.col("e") + 1e-8)
    return both.join(most, "video_id").select("video_id", "frame_idx", F.round(score, 9).alias("score"))


def non_uniform(frames: DataFrame, ratio: float) -> DataFrame:
    return selection.top_ratio(durable(non_uniform_scores(frames)), ratio)


def stepped_rewards(features: DataFrame, length: int = 30, size: int = 5, chunk: int | None = 4096) -> DataFrame:
    """(video_id, frame_idx, score): what a frame adds to evenly stepped context."""

    def make(frames: DataFrame, window) -> DataFrame:
        past = frames.withColumn("ctx", context.stepped_context(history("feat", length, window), size))
        return past.withColumn("score", F.round(context.delta_map(F.col("feat"), F.col("ctx")), 9)).drop("ctx", "feat")

    return chunked(features.select("video_id", "frame_idx", "feat"), chunk, length, make)


def semantic_ablation(features: DataFrame, ratio: float, length: int = 15, size: int = 3) -> DataFrame:
    """Kept frames by delta and novelty against clustered context, without class weight."""
    m = durable(context.context_measures(features, "diverse", length, size))
    return selection.top_ratio(m.select("video_id", "frame_idx", F.round(F.col("delta_map") * F.col("novelty"), 9).alias("score")), ratio)
