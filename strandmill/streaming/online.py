"""Online selection over a stream of scored frames, and the same decision in batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandmill.operators.sequential import fold

DECIDED = "video_id string, frame_idx long, score double, kept boolean, tau double"
STATE = "warm array<double>, tau double, last long, settled boolean"


class Decider:
    """During warm-up a frame is kept at or above the median so far; the frame that fills it sets tau for good."""

    def __init__(self, warmup: int, ratio: float, warm=(), tau: float | None = None, last: int = -1):
        self.warmup, self.ratio, self.warm, self.tau, self.last = warmup, min(0.99, max(0.01, ratio)), list(warm), tau, last

    def one(self, score: float) -> bool:
        if self.tau is None:
            self.warm.append(score)
            if len(self.warm) < self.warmup:
                return bool(score >= np.median(self.warm))
            self.tau, self.warm = float(np.quantile(self.warm, 1.0 - self.ratio)), []
        return bool(score > self.tau)

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["frame_idx"] > self.last].sort_values("frame_idx")
        kept, taus = [], []
        for s in rows["score"].tolist():
            kept.append(self.one(s))
            taus.append(self.tau)
        if len(rows):
            self.last = int(rows["frame_idx"].iloc[-1])
        return pd.DataFrame({"video_id": rows["video_id"].to_numpy(), "frame_idx": rows["frame_idx"].to_numpy("int64"), "score": rows["score"].to_numpy("float64"), "kept": np.array(kept, bool), "tau": np.array(taus, "float64")})

    def finish(self):
        return None


def _rows(scores: DataFrame) -> DataFrame:
    return scores.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("score").cast("double").alias("score"))


def online_keep(scores: DataFrame, warmup: int = 120, ratio: float = 0.2) -> DataFrame:
    """(video_id, frame_idx, score, kept, tau) in batch."""
    return fold(_rows(scores), DECIDED, lambda _: Decider(warmup, ratio))


def online_keep_stream(scores: DataFrame, warmup: int = 120, ratio: float = 0.2, idle: str | None = None) -> DataFrame:
    """The same for a streaming DataFrame, with state a video: the warm-up scores, then only tau and the last place.

    Frames at or before the last place seen are late and dropped. State of a video without frames for ``idle`` is let go;
    without ``idle`` it stays, as a query that ends when its input does must have it.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        warm, tau, last, settled = state.get if state.exists else ([], None, -1, False)
        d = Decider(warmup, ratio, warm, tau if settled else None, last)
        rows = pd.concat(list(batches), ignore_index=True)
        out = d.step(rows)
        state.update((d.warm, d.tau if d.tau is not None else 0.0, d.last, d.tau is not None))
        if wait:
            state.setTimeoutDuration(wait)
        if len(out):
            yield out

    return _rows(scores).groupBy("video_id").applyInPandasWithState(run, DECIDED, STATE, "append", timeout)


def windowed_rates(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window, video_id, frames, mean_score) over event time ``ts``; works on batch and streaming input."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "video_id").agg(F.count("*").alias("frames"), F.avg("score").alias("mean_score"))
