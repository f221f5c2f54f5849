"""Frame scans over tables, and a Python data source for raw frame files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FRAME_SCHEMA = "video_id string, frame_idx int, src_idx int, height int, width int, n_channels int, data binary"


def scan(frames: DataFrame, stride: int = 1, max_frames: int | None = None) -> DataFrame:
    """Every ``stride``-th source frame, at most ``max_frames`` a video; frame_idx numbers those that are kept.

    Both limits are filters on src_idx, so they reach the reader and need no window.
    """
    stride = max(1, stride)
    out = frames.where(F.col("src_idx") % stride == 0)
    if max_frames is not None:
        out = out.where(F.col("src_idx") < F.lit(max_frames * stride))
    return out.withColumn("frame_idx", F.floor(F.col("src_idx") / stride).cast("int"))


class _Span(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class RawFrames(DataSource):
    """spark.read.format("raw_frames").option("stride", 2).load(folder): files of equal-sized raw frames.

    A file NAME.raw has a NAME.json beside it with height, width and n_channels. Skipped frames aren't read. The folder
    must be visible to all executors. ``write_raw`` writes such files.
    """

    @classmethod
    def name(cls):
        return "raw_frames"

    def schema(self):
        return FRAME_SCHEMA

    def reader(self, schema):
        return _RawReader(self.options)

    def writer(self, schema, overwrite):
        return _RawWriter(self.options, overwrite)


class _RawReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.stride = max(1, int(options.get("stride", 1)))
        limit = options.get("max_frames")
        self.limit = None if limit in (None, "") else int(limit)
        self.span = int(options.get("frames_per_task", 4096))

    def _meta(self, path):
        with open(path[:-4] + ".json") as f:
            meta = json.load(f)
        return int(meta["height"]), int(meta["width"]), int(meta["n_channels"])

    def partitions(self):
        out = []
        for name in sorted(os.listdir(self.folder)):
            if name.endswith(".raw"):
                path = os.path.join(self.folder, name)
                h, w, c = self._meta(path)
                n = -(-(os.path.getsize(path) // (h * w * c)) // self.stride)
                n = n if self.limit is None else min(n, self.limit)
                out += [_Span(path, a, min(n, a + self.span)) for a in range(0, n, self.span)]
        return out

    def read(self, partition):
        h, w, c = self._meta(partition.path)
        video = os.path.basename(partition.path)[:-4]
        with open(partition.path, "rb") as f:
            for i in range(partition.first, partition.last):
                f.seek(i * self.stride * h * w * c)
                yield (video, i, i * self.stride, h, w, c, f.read(h * w * c))


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _RawWriter(DataSourceWriter):
    """Files under other names until the whole job has succeeded; a video must come in one task, in order."""

    def __init__(self, options, overwrite):
        self.folder = options["path"]
        if not overwrite and os.path.isdir(self.folder) and any(n.endswith(".raw") for n in os.listdir(self.folder)):
            raise ValueError(f"{self.folder} holds raw frames already")

    def write(self, rows):
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        tail, files, held, out, meta = f"part{TaskContext.get().taskAttemptId()}", [], None, None, None
        for r in rows:
            if r.video_id != held:
                if out is not None:
                    out.close()
                held, meta = r.video_id, {"height": r.height, "width": r.width, "n_channels": r.n_channels}
                for end, text in ((".json", json.dumps(meta)), (".raw", None)):
                    made = os.path.join(self.folder, f".{held}{end}.{tail}")
                    files.append((made, os.path.join(self.folder, f"{held}{end}")))
                    out = open(made, "wb" if text is None else "w")
                    if text is not None:
                        out.write(text)
                        out.close()
            if (r.height, r.width, r.n_channels) != tuple(meta.values()):
                raise ValueError(f"frames of {held} differ in size")
            out.write(bytes(r.data))
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages):
        for m in messages:
            for made, name in m.files if m else ():
                os.replace(made, name)

    def abort(self, messages):
        for m in messages:
            for made, _ in m.files if m else ():
                if os.path.exists(made):
                    os.remove(made)


def write_raw(frames: DataFrame, folder: str, mode: str = "append") -> None:
    """The kept-frame sink: a raw file for each video of (video_id, frame_idx, height, width, n_channels, data), frames in order."""
    frames.sparkSession.dataSource.register(RawFrames)
    rows = frames.select("video_id", F.col("frame_idx").cast("int").alias("frame_idx"), F.col("frame_idx").cast("int").alias("src_idx"), "height", "width", "n_channels", "data")
    rows.repartition("video_id").sortWithinPartitions("video_id", "frame_idx").write.format("raw_frames").mode(mode).save(folder)


def materialised(frames: DataFrame) -> DataFrame:
    """All frames held for several passes, in memory and beyond that on the executors' disks; the caller unpersists them."""
    return frames.persist()


def video_meta(frames: DataFrame) -> DataFrame:
    """(video_id, width, height, frame_count) of a frame table; pixel data isn't read."""
    return frames.groupBy("video_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.count("*").alias("frame_count"))
