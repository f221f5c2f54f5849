"""Windows over a sequence's frames, and halo chunks that make long sequences parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEY, ORDER = "video_id", "frame_idx"


def frame_window(*more: str) -> WindowSpec:
    return Window.partitionBy(KEY, *more).orderBy(ORDER)


def history(col: str, length: int, window: WindowSpec | None = None) -> Column:
    """The last ``length`` values before the current frame, oldest first."""
    return F.collect_list(col).over((window or frame_window()).rowsBetween(-length, -1))


def halo_chunks(frames: DataFrame, chunk: int, halo: int) -> DataFrame:
    """Rows with a chunk number; every chunk also holds the ``halo`` frames before it, marked by halo = true.

    Window functions that look back at most ``halo`` frames then partition by (video_id, chunk), so one long sequence is
    spread over tasks. Needs frame_idx without gaps in the sense that looking back by rows is looking back by index.
    """
    own = F.floor(F.col(ORDER) / chunk).cast("long")
    reach = F.floor((F.col(ORDER) + halo) / chunk).cast("long")
    return frames.withColumn("chunk", F.explode(F.sequence(own, reach))).withColumn("halo", F.col("chunk") != own)


def chunked(frames: DataFrame, chunk: int | None, halo: int, make) -> DataFrame:
    """``make(frames, window)`` per chunk, without the halo rows; in one piece if ``chunk`` is None, as frame_idx with gaps needs it.

    ``make`` keeps the columns halo and chunk.
    """
    if chunk is None:
        return make(frames, frame_window())
    out = make(halo_chunks(frames, chunk, halo), frame_window("chunk"))
    return out.where(~F.col("halo")).drop("halo", "chunk")
