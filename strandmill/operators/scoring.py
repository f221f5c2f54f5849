"""Frame scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import vector
from strandmill.operators.windows import chunked


def _before(frames: DataFrame, col: str, chunk: int | None) -> DataFrame:
    """(video_id, frame_idx, col, before): the value of the frame before, null at first."""
    return chunked(frames.select("video_id", "frame_idx", col), chunk, 1, lambda rows, window: rows.withColumn("before", F.lag(col).over(window)))


def pixel_motion(frames: DataFrame, scale: float = 255.0, first: float = 1.0, chunk: int | None = 4096) -> DataFrame:
    """(video_id, frame_idx, motion): mean absolute change of px against the frame before."""
    return _before(frames, "px", chunk).select("video_id", "frame_idx", F.coalesce(vector.mean_abs_diff(F.col("px"), F.col("before")) / scale, F.lit(first)).alias("motion"))


def level_motion(frames: DataFrame, chunk: int | None = 4096) -> DataFrame:
    """(video_id, frame_idx, motion): change of level against the frame before, as a share of the video's largest; 1 at first."""
    step = _before(frames, "level", chunk).select("video_id", "frame_idx", F.abs(F.col("level") - F.col("before")).alias("step"))
    most = step.groupBy("video_id").agg(F.max("step").alias("most"))
    return step.join(most, "video_id").select("video_id", "frame_idx", F.when(F.col("step").isNull(), F.lit(1.0)).when(F.col("most") > 0, F.col("step") / F.col("most")).otherwise(F.lit(0.0)).alias("motion"))


def semantic(delta: Column, novelty: Column, weight: Column) -> Column:
    return delta * novelty * weight


def blended(sem: Column, motion: Column, objects: Column, cfg: dict) -> Column:
    """The score: motion is added, then presence and busy scenes set floors and multiply, in this order."""
    s, thr = cfg["scoring"], cfg["scoring"]["busy_motion_threshold"]
    score = sem + s["motion_blend"] * motion
    present = F.greatest(score, F.lit(float(s["vehicle_presence_floor"]))) * (1.0 + max(0.0, s["detection_score_boost"]) * F.least(objects, F.lit(8)))
    score = F.when(objects > 0, present).otherwise(score)
    busy = F.greatest(score, F.lit(float(s["busy_score_floor"]))) * (1.0 + s["busy_score_boost"] * F.least(objects, F.lit(10)))
    lively = score * (1.0 + 0.08 * F.least(objects, F.lit(6)))
    score = F.when((objects >= s["busy_objects_threshold"]) & (motion >= thr), busy).when((objects >= 1) & (motion >= thr * 0.5), lively).otherwise(score)
    return F.greatest(score, F.lit(float(s["min_score"])))


def score_frames(parts: DataFrame, cfg: dict) -> DataFrame:
    """The score table of (video_id, frame_idx, delta_map, novelty, n_context, motion, class_weight, n_objects)."""
    sem = semantic(F.col("delta_map"), F.col("novelty"), F.col("class_weight"))
    with_sem = parts.withColumn("semantic", sem)
    score = F.round(blended(F.col("semantic"), F.col("motion"), F.col("n_objects"), cfg), 9)
    return with_sem.withColumn("score", score).select("video_id", "frame_idx", "delta_map", "novelty", "motion", "class_weight", "n_objects", "n_context", "semantic", "score")
