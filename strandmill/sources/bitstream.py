"""The bitstream file: a JSON header, a separator line, and a NumPy archive of the compressed packets.

The header tells the key interval that the packets were coded with, so a reader needs no configuration.
"""

from __future__ import annotations

import io
import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what separates the header from the archive.
SEPARATOR = b"\n---\n"


def to_bytes(meta: dict, palette, packets: list[bytes], interval: int, level: int = 3, annex: bytes | None = None) -> bytes:
    level = min(9, max(0, int(meta.get("zlib_level", level))))
    head = {"meta": meta, "centroids": np.asarray(palette, np.float16).astype(float).tolist(), "n_frames": len(packets), "keyframe_interval": interval, "version": meta.get("version", 2)}
    if "rgb_keyframe_interval" in meta:
        head["rgb_keyframe_interval"] = meta["rgb_keyframe_interval"]
    if annex:
        head["video_annex_bytes"] = len(annex)
    small = [zlib.compress(p, level) if p else b"" for p in packets]
    text, out = json.dumps(head).encode() + SEPARATOR, io.BytesIO()
    arrays = {"header_len": np.array([len(text)], np.int64), "frame_lens": np.array([len(s) for s in small], np.int64), "frames": np.frombuffer(b"".join(small), np.uint8)}
    if annex:
        arrays["video_annex"] = np.frombuffer(annex, np.uint8)
    np.savez(out, **arrays)
    return text + out.getvalue()


def from_bytes(raw: bytes) -> tuple[dict, np.ndarray, list[bytes], bytes | None]:
    """(header, palette, packets, annex)."""
    cut = raw.index(SEPARATOR)
    head = json.loads(raw[:cut])
    with np.load(io.BytesIO(raw[cut + len(SEPARATOR) :]), allow_pickle=False) as data:
        ends = np.cumsum(data["frame_lens"])
        blob = data["frames"].tobytes()
        parts = [blob[e - n : e] for e, n in zip(ends.tolist(), data["frame_lens"].tolist())]
        annex = data["video_annex"].tobytes() if "video_annex" in data.files else None
    return head, np.array(head["centroids"], np.float32), [zlib.decompress(p) if p else b"" for p in parts], annex


def bitstreams(packets: DataFrame, palette, interval: int, meta: dict | None = None, level: int = 3) -> DataFrame:
    """(video_id, content): one bitstream file's bytes a video, of (video_id, frame_idx, payload).

    A file is one video by its format, so its packets (compressed, without pixels) meet in one task.
    """
    meta = dict(meta or {})

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_idx")
        return pd.DataFrame({"video_id": rows["video_id"].iloc[:1], "content": [to_bytes(meta, palette, [bytes(p) for p in rows["payload"]], interval, level)]})

    return packets.select("video_id", "frame_idx", "payload").groupBy("video_id").applyInPandas(pack, "video_id string, content binary")


def packets(content: DataFrame) -> DataFrame:
    """(video_id, frame_idx, payload, interval) of (video_id, content)."""

    def unpack(batches):
        for b in batches:
            rows = [(v, i, p, head["keyframe_interval"]) for v, c in zip(b["video_id"], b["content"]) for head, _, parts, _ in [from_bytes(bytes(c))] for i, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["video_id", "frame_idx", "payload", "interval"])

    return content.select("video_id", "content").mapInPandas(unpack, "video_id string, frame_idx int, payload binary, interval int")


def read_bitstreams(spark: SparkSession, path: str) -> DataFrame:
    """``packets`` of the files at ``path``; video_id is the file's name without its ending."""
    files = spark.read.format("binaryFile").load(path)
    return packets(files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("video_id"), "content"))
