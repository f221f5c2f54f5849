"""Context sets of recent frames, and what a frame adds to them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import vector
from strandmill.operators.windows import chunked, history

#: A distance of this much counts as wholly new (a fixed value, not the square root of 2).
FAR = 1.414


def uniform_context(past: Column, size: int) -> Column:
    """``size`` evenly spaced members of an array, or all of it if shorter."""
    n = F.size(past)
    step = F.greatest(F.lit(1), F.floor((n - 1) / max(size - 1, 1)).cast("int"))
    picked = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(past, F.least(n - 1, i * step).cast("int")))
    return F.when(n <= size, past).otherwise(picked)


def stepped_context(past: Column, size: int) -> Column:
    """Every (n div size)-th member, of those the last ``size``; fewer than three members stand as they are."""
    n = F.size(past)
    step = F.greatest(F.lit(1), F.floor(n / size).cast("int"))
    every = F.filter(past, lambda _, i: (i % step) == 0)
    return F.when(n < 3, past).otherwise(F.slice(every, F.greatest(F.lit(1), F.size(every) - size + 1), F.lit(size)))


def delta_map(feat: Column, context: Column) -> Column:
    """1 - the largest similarity to the context; 1 without context."""
    return F.when(F.size(context) == 0, F.lit(1.0)).otherwise(1.0 - F.array_max(F.transform(context, lambda e: vector.dot(feat, e))))


def novelty(feat: Column, centers: Column, power: float = 1.0) -> Column:
    """The distance to the nearest center against FAR, at most 1; 1 without centers."""
    near = F.least(F.lit(1.0), F.array_min(F.transform(centers, lambda c: vector.distance(feat, c))) / FAR)
    return F.when(F.size(centers) == 0, F.lit(1.0)).otherwise(near if power == 1.0 else F.pow(near, F.lit(power)))


def farthest_points(x: np.ndarray, k: int) -> list[int]:
    """The first row, then always the row farthest from those chosen; stops when none is new."""
    picked, near = [0], np.linalg.norm(x - x[0], axis=1)
    while len(picked) < min(k, len(x)):
        far = int(near.argmax())
        if far in picked:
            break
        picked.append(far)
        near = np.minimum(near, np.linalg.norm(x - x[far], axis=1))
    return picked


def diverse_context(x: np.ndarray, size: int, min_samples: int = 3, rounds: int = 30) -> tuple[list[int], np.ndarray]:
    """(representatives, centers) of the rows of ``x``: Lloyd's algorithm from farthest points, so without any chance.

    Representatives are the members nearest their center; empty clusters have none.
    """
    n = len(x)
    if n == 0:
        return [], np.zeros((0, 0))
    k = min(size, n)
    seeds = farthest_points(x, k)
    if n < min_samples or k <= 1:
        return seeds, x[seeds]
    centers, label = x[seeds].copy(), None
    for _ in range(rounds):
        away = ((x[:, None, :] - centers[None, :, :]) ** 2).sum(2)
        new = away.argmin(1)
        if label is not None and (new == label).all():
            break
        label = new
        for c in range(len(centers)):
            if (label == c).any():
                centers[c] = x[label == c].mean(0)
    away = ((x[:, None, :] - centers[None, :, :]) ** 2).sum(2)
    reps = [int(m[away[m, c].argmin()]) for c in range(len(centers)) if len(m := np.flatnonzero(label == c))]
    return reps, centers


def diverse_measures(size: int, min_samples: int = 3):
    """Pandas UDF (feat, past) -> struct(delta_map, novelty, n_context) with clustered context."""

    @F.pandas_udf("delta_map double, novelty double, n_context int")
    def measure(feat: pd.Series, past: pd.Series) -> pd.DataFrame:
        rows = []
        for f, h in zip(feat, past):
            if len(h) == 0:
                rows.append((1.0, 1.0, 0))
                continue
            x, f = np.stack([np.asarray(v, float) for v in h]), np.asarray(f, float)
            reps, centers = diverse_context(x, size, min_samples)
            rows.append((1.0 - float((x[reps] @ f).max()), min(1.0, float(np.linalg.norm(centers - f, axis=1).min()) / FAR), len(reps)))
        return pd.DataFrame(rows, columns=["delta_map", "novelty", "n_context"])

    return measure


def context_measures(features: DataFrame, mode: str = "uniform", length: int = 15, size: int = 3, min_samples: int = 3, power: float = 1.0, chunk: int | None = 4096) -> DataFrame:
    """(video_id, frame_idx, delta_map, novelty, n_context) of (video_id, frame_idx, feat).

    chunk: frames a task takes of one sequence at a time; None if frame_idx may have gaps.
    """

    def make(frames: DataFrame, window) -> DataFrame:
        past = frames.withColumn("past", history("feat", length, window))
        if mode == "uniform":
            past = past.withColumn("ctx", uniform_context(F.col("past"), size))
            return past.withColumns({"delta_map": delta_map(F.col("feat"), F.col("ctx")), "novelty": novelty(F.col("feat"), F.col("ctx"), power), "n_context": F.size("ctx")}).drop("past", "ctx", "feat")
        if mode != "diverse":
            raise ValueError(f"unknown context mode {mode!r}")
        found = past.withColumn("m", diverse_measures(size, min_samples)("feat", "past"))
        return found.withColumns({"delta_map": F.col("m.delta_map"), "novelty": F.pow("m.novelty", F.lit(power)), "n_context": F.col("m.n_context")}).drop("past", "m", "feat")

    frames = features.select("video_id", "frame_idx", "feat")
    return chunked(frames, chunk, length, make)


def delta_maps(features: DataFrame, length: int, chunk: int | None = 4096) -> DataFrame:
    """(video_id, frame_idx, delta_map) against all of the last ``length`` frames."""

    def make(frames: DataFrame, window) -> DataFrame:
        return frames.withColumn("past", history("feat", length, window)).withColumn("delta_map", delta_map(F.col("feat"), F.col("past"))).drop("past", "feat")

    return chunked(features.select("video_id", "frame_idx", "feat"), chunk, length, make)
