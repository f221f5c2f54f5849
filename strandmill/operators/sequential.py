"""Folds over each sequence in order, for operators that need their own earlier output.

Rows are dealt out by sequence and sorted within partitions, then streamed through a state object per sequence. Memory is
bounded by the state and one batch, not by the sequence.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def fold(frames: DataFrame, schema: str, make: Callable[[str], object], key: str = "video_id", order: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """``make(key)`` gives an object with step(rows: pandas) -> pandas, called with consecutive rows, and finish() -> pandas or None."""

    def run(batches):
        held, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            cuts = batch[key].ne(batch[key].shift()).cumsum()
            for _, rows in batch.groupby(cuts, sort=False):
                k = rows[key].iloc[0]
                if state is None or k != held:
                    if state is not None and (last := state.finish()) is not None:
                        yield last
                    held, state = k, make(k)
                out = state.step(rows)
                if out is not None and len(out):
                    yield out
        if state is not None and (last := state.finish()) is not None:
            yield last

    return frames.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


class Collecting:
    """State that takes a whole sequence; for operators that choose among all its frames."""

    def __init__(self):
        self.parts: list[pd.DataFrame] = []

    def step(self, rows: pd.DataFrame):
        self.parts.append(rows)

    def finish(self):
        return self.whole(pd.concat(self.parts, ignore_index=True))

    def whole(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError
