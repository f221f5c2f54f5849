"""Distribution statistics, thresholds and retention bounds, one row a video. Percentiles are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.order_statistics import at_places, quantiles
from strandmill.session import durable


def _values(scores: DataFrame, col: str = "score") -> DataFrame:
    return scores.select("video_id", F.col(col).cast("double").alias("value"))


def score_stats(scores: DataFrame) -> DataFrame:
    share = lambda cond: F.avg(cond.cast("double"))
    s = F.col("score")
    rest = scores.groupBy("video_id").agg(F.min(s).alias("min"), F.max(s).alias("max"), share(s < 1e-4).alias("frac_below_1e4"), share(s > 0.01).alias("frac_above_001"))
    found = rest.join(quantiles(_values(scores), {"median": 0.5, "p90": 0.9}), "video_id", "left")
    return found.select("video_id", "min", "max", "median", "p90", "frac_below_1e4", "frac_above_001")


def calibrate_tau(scores: DataFrame, ratio: float) -> DataFrame:
    """(video_id, tau): the quantile above which a share ``ratio``, held to 0.01 to 0.99, lies."""
    return quantiles(_values(scores), {"tau": 1.0 - min(0.99, max(0.01, ratio))}).select("video_id", "tau")


def adaptive_tau(scores: DataFrame, cfg: dict, more: dict[str, Column] | None = None, extra: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(video_id, tau): median + m * MAD of the scores over their 95th percentile, with a flat quantile for flat clips.

    ``more``, ``extra`` and ``known``: values at further places, as ``order_statistics.at_places`` takes and gives them.
    """
    a = cfg["adaptive"]
    asked = {"p95": 0.95, "mid": 0.5, "flat": float(a["flat_quantile"]), "low": float(a["min_tau_quantile"])}
    first = at_places(_values(scores), {**{name: (F.col("n") - 1) * q for name, q in asked.items()}, **(more or {})}, extra, known)
    first = durable(first.withColumn("scale", F.col("p95") + F.lit(1e-12)))  # one row a video
    away = scores.join(first.select("video_id", "scale", "mid"), "video_id").select("video_id", F.abs(F.col("score") / F.col("scale") - F.col("mid") / F.col("scale")).alias("value"))
    spread = quantiles(away, {"mad0": 0.5}).select("video_id", "mad0")
    mad = F.col("mad0") + F.lit(1e-12)
    by_mad = F.when(mad < 0.02, F.col("flat") / F.col("scale")).otherwise(F.col("mid") / F.col("scale") + float(a["mad_multiplier"]) * mad)
    tau = F.when(F.col("scale") < 1e-4, F.col("flat")).otherwise(F.greatest(by_mad, F.col("low") / F.col("scale") * 0.5) * F.col("scale"))
    return first.join(spread, "video_id").select("video_id", tau.alias("tau"), *(more or {}))


def clip_richness(frames: DataFrame, cfg: dict) -> DataFrame:
    """(video_id, n, busy, information) of (video_id, n_objects, motion)."""
    s = cfg["scoring"]
    share = lambda cond: F.avg(cond.cast("double"))
    n, m, thr = F.col("n_objects"), F.col("motion"), float(s["busy_motion_threshold"])
    busy = share((n >= s["busy_objects_threshold"]) & (m >= thr))
    rich = F.greatest(busy, share(n >= 1) * 0.9, share(n >= 2) * 0.85, F.avg(F.least(n, F.lit(6)).cast("double")) / 6.0 * 0.8, share(m >= thr * 0.5) * 0.6)
    return frames.groupBy("video_id").agg(F.count("*").alias("n"), busy.alias("busy"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), rich)).alias("information"))


def retention_bounds(richness: DataFrame, cfg: dict) -> DataFrame:
    """(video_id, n, n_min, soft_n, n_max): how many frames adaptive selection keeps, by the clip's richness."""
    a = cfg["adaptive"]
    part = F.lit(0.0)
    if a.get("information_aware"):
        part = F.col("information")
    elif a.get("traffic_aware", True):
        part = F.col("busy")
    toward = lambda low, high: F.lit(float(low)) + part * (float(high) - float(low))
    least = toward(a["min_retention_ratio"], a["busy_min_retention_floor"])
    most = float(a["max_retention_ratio"])
    # as numpy's clip does: the upper bound wins
    soft = F.least(F.greatest(toward(a["soft_target_retention"], a["busy_soft_retention_cap"]), least), F.lit(most - 0.02))
    count = lambda share: F.bround(F.col("n") * share).cast("long")
    lo = F.greatest(F.lit(1), count(least))
    mid = F.greatest(lo, count(soft))
    return richness.select("video_id", "n", lo.alias("n_min"), mid.alias("soft_n"), F.greatest(mid, count(F.lit(most))).alias("n_max"))
