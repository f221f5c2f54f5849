"""Which frames are kept. Ties go to the lower frame_idx everywhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators import thresholds
from strandmill.operators.order_statistics import quantiles, sketch, top_rows
from strandmill.operators.sequential import Collecting, fold
from strandmill.session import durable

GAP, PENALTY = 4, 0.45


def keep_counts(scores: DataFrame, ratio: float) -> DataFrame:
    """(video_id, n, k): k = the ratio of n rounded half to even, at least 1."""
    return scores.groupBy("video_id").agg(F.count("*").alias("n")).withColumn("k", F.greatest(F.lit(1), F.bround(F.col("n") * ratio).cast("long")))


def top_ratio(scores: DataFrame, ratio: float) -> DataFrame:
    """(video_id, frame_idx, score) of the top k of each video."""
    return top_rows(scores, keep_counts(scores, ratio)).select("video_id", "frame_idx", "score")


def target_ratio(scores: DataFrame, ratio: float) -> DataFrame:
    """``top_ratio`` with the informational threshold tau, as ``thresholds.calibrate_tau`` has it."""
    tau = (F.col("n") - 1) * (1.0 - min(0.99, max(0.01, ratio)))
    return top_rows(scores, keep_counts(scores, ratio), more={"tau": tau}).select("video_id", "frame_idx", "score", "tau")


def every_kth(frames: DataFrame, k: int) -> DataFrame:
    return frames.where(F.col("frame_idx") % k == 0)


def gap_picks(scores: np.ndarray, keep: int, gap: int = GAP) -> list[int]:
    """By falling score, never within ``gap`` of a chosen place; then filled up by score. Places, in order."""
    n = len(scores)
    order = np.lexsort((np.arange(n), -scores))
    gap = max(1, gap)
    blocked, chosen = np.zeros(n, bool), []
    for i in order.tolist():
        if len(chosen) >= keep:
            break
        if not blocked[i]:
            chosen.append(i)
            blocked[max(0, i - gap + 1) : i + gap] = True
    if len(chosen) < keep:
        chosen += order[~np.isin(order, chosen)][: keep - len(chosen)].tolist()
    return sorted(chosen)


def diverse_picks(scores: np.ndarray, keep: int, feats: np.ndarray | None, gap: int = GAP, penalty: float = PENALTY) -> list[int]:
    """Greedy choice of score less ``penalty`` times the largest similarity to the chosen, ``gap`` apart while possible.

    One running vector of largest similarities makes it O(keep * n). A large share (over 800, or a quarter) goes to
    ``gap_picks``.
    """
    n = len(scores)
    keep = max(1, min(keep, n)) if n else 0
    if keep >= n:
        return list(range(n))
    if keep > 800 or keep > n * 0.25:
        return gap_picks(scores, keep, gap)
    gap, chosen = max(1, gap), []
    nearest, free = np.full(n, np.inf), np.ones(n, bool)
    likeness = np.full(n, -np.inf)
    while len(chosen) < keep:
        open_ = free & (nearest >= gap)
        if not open_.any():
            if gap == 1:
                break
            gap -= 1
            continue
        worth = scores - penalty * likeness if feats is not None and chosen else scores.astype(float)
        i = int(np.where(open_, worth, -np.inf).argmax())
        chosen.append(i)
        free[i] = False
        nearest = np.minimum(nearest, np.abs(np.arange(n) - i))
        if feats is not None:
            likeness = np.maximum(likeness, feats @ feats[i])
    return sorted(chosen)


class _Pick(Collecting):
    def __init__(self, choose):
        super().__init__()
        self.choose = choose

    def whole(self, rows):
        return rows.iloc[self.choose(rows)][["video_id", "frame_idx", "score"]]


KEPT = "video_id string, frame_idx long, score double"


def gap_topk(scores: DataFrame, ratio: float, gap: int = GAP) -> DataFrame:
    """(video_id, frame_idx, score) chosen by ``gap_picks``, the ratio of each video. Sequential in a video by nature."""
    return fold(scores.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "score"), KEPT, lambda _: _Pick(lambda r: gap_picks(r["score"].to_numpy(), max(1, round(len(r) * ratio)), gap)))


def diverse_topk(scores: DataFrame, ratio: float, gap: int = GAP, penalty: float = PENALTY) -> DataFrame:
    """(video_id, frame_idx, score) of (video_id, frame_idx, score, feat), chosen by ``diverse_picks``."""

    def choose(rows: pd.DataFrame):
        return diverse_picks(rows["score"].to_numpy(), max(1, round(len(rows) * ratio)), np.stack(rows["feat"].to_numpy()).astype(float), gap, penalty)

    return fold(scores.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "score", "feat"), KEPT, lambda _: _Pick(choose))


def adaptive_plan(scores: DataFrame, bounds: DataFrame, cfg: dict, tau: float | None = None, known: DataFrame | None = None) -> DataFrame:
    """(video_id, k, n_max, tau): k frames are kept, and tau is the threshold reported.

    If too few frames exceed the first threshold, it is set anew as the quantile of soft_n, and the places up to soft_n are filled by
    rank; so k = max(frames above the first threshold, soft_n), or n_max beyond that.
    """
    if tau is None:
        # tau2 is the linear quantile at 1 - the share of soft_n
        place = (F.lit(1.0) - F.col("soft_n") / F.col("n")) * (F.col("n") - 1)
        first = thresholds.adaptive_tau(scores, cfg, {"tau2": place}, bounds.select("video_id", "soft_n"), known).withColumnRenamed("tau", "tau0")
    else:
        first = bounds.select("video_id", F.lit(float(tau)).alias("tau0"), F.lit(float(tau)).alias("tau2"))
    above = scores.join(first, "video_id").groupBy("video_id", "tau0", "tau2").agg(F.sum((F.col("score") > F.round("tau0", 9)).cast("long")).alias("above"))
    both = bounds.join(above, "video_id")
    k = F.greatest("above", "soft_n")
    return both.select("video_id", F.least(k, F.col("n_max")).alias("k"), (k > F.col("n_max")).alias("too_many"), F.when(F.col("above") < F.col("soft_n"), F.col("tau2")).otherwise(F.col("tau0")).alias("tau"))


def adaptive_select(scores: DataFrame, bounds: DataFrame, cfg: dict, tau: float | None = None) -> DataFrame:
    """(video_id, frame_idx, score, tau) of the frames kept.

    Videos with more frames above the threshold than n_max are thinned with gaps; the others, by rank. The scores are read
    several times, so they had better be ``session.durable``.
    """
    known = durable(sketch(scores.select("video_id", F.col("score").alias("value"))))
    plan = durable(adaptive_plan(scores, bounds, cfg, tau, known))
    by_rank = top_rows(scores, plan.where("not too_many"), known).select("video_id", "frame_idx", "score", "tau")
    many = scores.join(plan.where("too_many"), "video_id").select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "score", "k", "tau")

    class Thin(Collecting):
        def whole(self, rows):
            return rows.iloc[diverse_picks(rows["score"].to_numpy(), int(rows["k"].iloc[0]), None)][["video_id", "frame_idx", "score", "tau"]]

    thinned = fold(many, KEPT + ", tau double", lambda _: Thin())
    kind = scores.schema["frame_idx"].dataType
    return by_rank.unionByName(thinned.withColumn("frame_idx", F.col("frame_idx").cast(kind)))


def motion_gate(motion: DataFrame, fraction: float = 0.35, floor_interval: int = 6) -> DataFrame:
    """(video_id, frame_idx, motion, candidate): frames of much motion, and every ``floor_interval``-th, go to the heavy model."""
    fraction = min(1.0, max(0.05, fraction))
    limit = quantiles(motion.select("video_id", F.col("motion").alias("value")), {"limit": 1.0 - fraction})
    by_motion = F.col("motion") >= F.round("limit", 9)
    by_place = (F.col("frame_idx") % floor_interval == 0) if floor_interval > 0 else F.lit(False)
    return motion.withColumn("motion", F.round("motion", 9)).join(limit, "video_id").select("video_id", "frame_idx", "motion", (by_motion | by_place).alias("candidate"))


def gated_scores(gate: DataFrame, heavy: DataFrame) -> DataFrame:
    """Scores of the candidates from ``heavy`` (video_id, frame_idx, score), motion for the others."""
    return gate.join(heavy, ["video_id", "frame_idx"], "left").select("video_id", "frame_idx", F.when(F.col("candidate"), F.coalesce("score", "motion")).otherwise(F.col("motion")).alias("score"))


def kept_frames(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """The second pass of a scan: frames in the kept set. Spark broadcasts the set if it is small, else sorts and merges."""
    return frames.join(kept.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_semi")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(video_id, both, only_a, only_b, jaccard) of two kept sets."""
    left, right = (x.select("video_id", "frame_idx").distinct().withColumn(n, F.lit(1)) for x, n in ((a, "a"), (b, "b")))
    return left.join(right, ["video_id", "frame_idx"], "full").groupBy("video_id").agg(
        F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"),
        F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"),
        F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"),
        F.round(F.avg((F.col("a").isNotNull() & F.col("b").isNotNull()).cast("double")), 6).alias("jaccard"),
    )
