"""Manifests, reports and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import measures

KEYS = ["video_id", "frame_idx"]


def manifest(kept: DataFrame, totals: DataFrame, method: str) -> DataFrame:
    """(video_id, method, indices, n_total, n_kept, retention_ratio); totals: (video_id, n)."""
    lists = kept.groupBy("video_id").agg(F.sort_array(F.collect_list(F.col("frame_idx").cast("long"))).alias("indices"))
    both = totals.join(lists, "video_id", "left").withColumn("indices", F.coalesce("indices", F.array().cast("array<bigint>")))
    n = F.size("indices").cast("long")
    return both.select("video_id", F.lit(method).alias("method"), "indices", F.col("n").alias("n_total"), n.alias("n_kept"), measures.retention_ratio(n, F.col("n")).alias("retention_ratio"))


def as_json(rows: DataFrame) -> DataFrame:
    """(video_id, json)."""
    return rows.select("video_id", F.to_json(F.struct(*[c for c in rows.columns if c != "video_id"])).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    as_json(rows).select("json").write.mode("errorifexists").text(path)


def overlay(frames: DataFrame, scores: DataFrame, kept: DataFrame) -> DataFrame:
    """(video_id, frame_idx, state, caption) for every frame; frames without a score show 0."""
    marks = kept.select(*KEYS, F.lit(True).alias("kept"))
    both = frames.select(*KEYS).join(scores.select(*KEYS, "score"), KEYS, "left").join(marks, KEYS, "left")
    state = F.when(F.col("kept"), F.lit("KEEP")).otherwise(F.lit("SKIP"))
    return both.select(*KEYS, state.alias("state"), F.format_string("%s #%d  score=%.2e", state, F.col("frame_idx").cast("long"), F.coalesce("score", F.lit(0.0))).alias("caption"))


def transmission(videos: DataFrame, share: float = 0.25) -> DataFrame:
    """Sizes, savings and modelled transmission times of videos (video_id, fps, frame_count, size_bytes) cut to ``share`` of their bytes."""
    small = F.floor(F.col("size_bytes") * share)
    return videos.select(
        "video_id",
        F.round(measures.normal_fps(F.col("fps")), 6).alias("fps"),
        measures.frame_estimate(F.col("frame_count"), 2, None).alias("frames_estimate"),
        measures.megabytes(F.col("size_bytes"), 6).alias("original_mb"),
        measures.megabytes(small, 6).alias("compressed_mb"),
        F.round(measures.size_reduction_pct(F.col("size_bytes"), small), 6).alias("saving_pct"),
        F.round(measures.transmission_seconds(F.col("size_bytes")), 9).alias("tx_original_s"),
        F.round(measures.transmission_seconds(small), 9).alias("tx_compressed_s"),
    )


def compression_summary(videos: DataFrame, sizes: DataFrame) -> DataFrame:
    """Like ``transmission`` for coded videos: sizes (video_id, n_frames, compressed_bytes). A file coded in part counts in part."""
    whole = F.when((F.col("frame_count") > 0) & (F.col("n_frames") < F.col("frame_count")), F.floor(F.col("size_bytes") * (F.col("n_frames") / F.col("frame_count")))).otherwise(F.col("size_bytes"))
    both = videos.join(sizes, "video_id").withColumn("original", whole)
    return both.select("video_id", "n_frames", measures.megabytes(F.col("original"), 6).alias("original_mb"), measures.megabytes(F.col("compressed_bytes"), 6).alias("compressed_mb"), F.round(measures.size_reduction_pct(F.col("original"), F.col("compressed_bytes")), 6).alias("saving_pct"))
