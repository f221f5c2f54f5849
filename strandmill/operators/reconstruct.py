"""Filling frames between keys, temporal smoothing and picture quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import measures, vector
from strandmill.operators.sequential import fold
from strandmill.operators.windows import chunked


def key_segments(frames: DataFrame, interval: int) -> DataFrame:
    """Frames with key0, key1 and alpha; a last segment without a next key stands on its first."""
    last = frames.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n"))
    k0 = (F.floor(F.col("frame_idx") / interval) * interval).cast("int")
    k1 = F.when(k0 + interval >= F.col("n"), k0).otherwise(k0 + interval).cast("int")
    alpha = F.when(k1 == k0, F.lit(0.0)).otherwise((F.col("frame_idx") - k0) / F.lit(float(interval)))
    return frames.join(last, "video_id").select("video_id", "frame_idx", k0.alias("key0"), k1.alias("key1"), alpha.alias("alpha"))


def linear_interpolation(frames: DataFrame, interval: int) -> DataFrame:
    """(video_id, frame_idx, px): each frame as the blend of its keys, cut to whole levels. Only key frames' px are read."""
    keys = frames.where(F.col("frame_idx") % interval == 0).select("video_id", "frame_idx", "px")
    segments = key_segments(frames.select("video_id", "frame_idx"), interval)
    first = keys.select("video_id", F.col("frame_idx").alias("key0"), F.col("px").alias("a0"))
    second = keys.select("video_id", F.col("frame_idx").alias("key1"), F.col("px").alias("a1"))
    both = segments.join(first, ["video_id", "key0"]).join(second, ["video_id", "key1"])
    mixed = F.zip_with("a0", "a1", lambda x, y: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(x * (1.0 - F.col("alpha")) + y * F.col("alpha"), 6)))).cast("int"))
    return both.select("video_id", "frame_idx", mixed.alias("px"))


def quality(a: DataFrame, b: DataFrame) -> DataFrame:
    """(video_id, frame_idx, psnr, ssim) of frames matched by place."""
    pairs = a.select("video_id", "frame_idx", F.transform("px", lambda v: v.cast("double")).alias("a")).join(b.select("video_id", "frame_idx", F.transform("px", lambda v: v.cast("double")).alias("b")), ["video_id", "frame_idx"])
    n = F.size("a")
    means = pairs.withColumns({"ma": vector.total("a") / n, "mb": vector.total("b") / n})
    product = lambda f: vector.total(F.zip_with("a", "b", f)) / n
    x, y = lambda v: v - F.col("ma"), lambda v: v - F.col("mb")
    stats = means.select(
        "video_id", "frame_idx", "ma", "mb", product(lambda p, q: (p - q) * (p - q)).alias("mse"),
        product(lambda p, q: x(p) * x(p)).alias("va"), product(lambda p, q: y(q) * y(q)).alias("vb"), product(lambda p, q: x(p) * y(q)).alias("c"),
    )
    return stats.select("video_id", "frame_idx", measures.psnr(F.col("mse")).alias("psnr"), measures.global_ssim(*[F.col(c) for c in ("ma", "mb", "va", "vb", "c")]).alias("ssim"))


def hybrid_blend(frames: DataFrame, keys: DataFrame, interval: int, share: float) -> DataFrame:
    """(video_id, frame_idx, px): each frame mixed with the last key picture, ``share`` of it; key frames stand as they are.

    keys: (video_id, frame_idx, px) of every ``interval``-th frame; a frame without its key stands too.
    """
    at = frames.select("video_id", "frame_idx", "px", (F.floor(F.col("frame_idx") / interval) * interval).cast("int").alias("key"))
    both = at.join(keys.select("video_id", F.col("frame_idx").cast("int").alias("key"), F.col("px").alias("k")), ["video_id", "key"], "left")
    mixed = F.zip_with("px", "k", lambda p, q: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(p * (1.0 - share) + q * share, 6)))).cast("int"))
    return both.select("video_id", "frame_idx", F.when(F.col("k").isNull() | (F.col("key") == F.col("frame_idx")), F.col("px")).otherwise(mixed).alias("px"))


def residual_blend(frames: DataFrame, model: DataFrame, share: float) -> DataFrame:
    """(video_id, frame_idx, px): frames moved towards a model's output (video_id, frame_idx, px) by ``share`` of the difference."""
    both = frames.select("video_id", "frame_idx", "px").join(model.select("video_id", "frame_idx", F.col("px").alias("m")), ["video_id", "frame_idx"], "left")
    moved = F.zip_with("px", "m", lambda p, q: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(p + (q - p) * share, 6)))).cast("int"))
    return both.select("video_id", "frame_idx", F.when(F.col("m").isNull(), F.col("px")).otherwise(moved).alias("px"))


def temporal_stack(frames: DataFrame, size: int, chunk: int | None = 4096) -> DataFrame:
    """(video_id, frame_idx, stack): the last ``size`` label maps with the current one, padded in front with the first."""

    def make(rows: DataFrame, window) -> DataFrame:
        held = rows.withColumn("h", F.collect_list("labels").over(window.rowsBetween(-(size - 1), 0)))
        return held.withColumn("stack", F.concat(F.array_repeat(F.col("h")[0], F.lit(size) - F.size("h")), F.col("h"))).drop("h", "labels")

    return chunked(frames.select("video_id", "frame_idx", "labels"), chunk, size - 1, make)


class _Smooth:
    """Blend with a short history, then with the last output."""

    def __init__(self, strength: float, window: int, interval: int):
        self.strength, self.window, self.interval = strength, window, interval
        self.past: list[np.ndarray] = []
        self.last: np.ndarray | None = None

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = [self.one(np.asarray(p, np.float32), int(i)) for p, i in zip(rows["px"], rows["frame_idx"])]
        return pd.DataFrame({"video_id": rows["video_id"].to_numpy(), "frame_idx": rows["frame_idx"].to_numpy(), "px": out})

    def one(self, px: np.ndarray, idx: int) -> np.ndarray:
        if self.strength > 0:
            if self.window > 1:
                self.past = [*self.past, px][-self.window :]
                if len(self.past) > 1:
                    mix = self.past[0]
                    for p in self.past[1:]:
                        mix = mix * np.float32(0.55) + p * np.float32(0.45)
                    px = np.floor(np.clip(mix, 0, 255))
            if self.last is not None:
                s = np.float32(min(self.strength * (1.2 if idx % self.interval == 0 else 1.0), 0.52))
                px = np.floor(np.clip(px * (1 - s) + self.last * s, 0, 255))
        self.last = px
        return px.astype(np.int32)

    def finish(self):
        return None


def temporal_smooth(frames: DataFrame, strength: float = 0.3, window: int = 3, interval: int = 30) -> DataFrame:
    """(video_id, frame_idx, px) smoothed in time; each output feeds the next, so a video is one fold."""
    rows = frames.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "px")
    return fold(rows, "video_id string, frame_idx long, px array<int>", lambda _: _Smooth(strength, window, interval))
