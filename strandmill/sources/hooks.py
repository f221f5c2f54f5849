"""Interfaces to models and codecs that are not part of this library.

A hook that is asked for and not registered raises; there is never a silent empty result. Two need no library and are
registered from the start: a lossless picture codec, ``zlib``, and optical flow by block matching, ``block``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

#: Names that can be registered: feature extractors, detectors and codecs.
EMBEDDERS = ("mobilenet_v3_small", "resnet18", "efficientnet_b0")
KINDS = ("embed", "detect", "decode_video", "encode_video", "encode_picture", "decode_picture", "optical_flow", "enhance", "inpaint", "reconstruct")

_REGISTERED: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, make: Callable) -> None:
    """``make()`` is called once a Python worker and gives a function on a list of rows."""
    if kind not in KINDS:
        raise ValueError(f"unknown hook kind {kind!r}")
    _REGISTERED[kind, name] = make


def lookup(kind: str, name: str) -> Callable:
    if kind == "embed" and name not in EMBEDDERS and (kind, name) not in _REGISTERED:
        raise ValueError(f"unknown backbone {name!r}")
    if (kind, name) not in _REGISTERED:
        raise NotImplementedError(f"no {kind} hook named {name!r} is registered")
    return _REGISTERED[kind, name]


def apply(frames: DataFrame, kind: str, name: str, schema: str, batch: int = 32) -> DataFrame:
    """Run a hook over frames in batches; its function takes a pandas frame and returns one of ``schema``."""
    make = lookup(kind, name)

    def run(batches):
        model = make()
        for rows in batches:
            for at in range(0, len(rows), batch):
                out = model(rows.iloc[at : at + batch])
                yield out if isinstance(out, pd.DataFrame) else pd.DataFrame(out)

    return frames.mapInPandas(run, schema)


def _zlib_encoder(level: int = 1) -> Callable:
    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        coded = [zlib.compress(struct.pack("<III", h, w, c) + d, level) for h, w, c, d in zip(rows["height"], rows["width"], rows["n_channels"], rows["data"])]
        return pd.DataFrame({"video_id": rows["video_id"], "frame_idx": rows["frame_idx"], "picture": coded})

    return encode


def _zlib_decoder() -> Callable:
    def decode(rows: pd.DataFrame) -> pd.DataFrame:
        plain = [zlib.decompress(p) for p in rows["picture"]]
        sizes = [struct.unpack("<III", p[:12]) for p in plain]
        return pd.DataFrame({"video_id": rows["video_id"], "frame_idx": rows["frame_idx"], **{n: [s[k] for s in sizes] for k, n in enumerate(("height", "width", "n_channels"))}, "data": [p[12:] for p in plain]})

    return decode


def _block_flow() -> Callable:
    from strandmill.operators.imaging import block_flow

    return block_flow


register("encode_picture", "zlib", _zlib_encoder)
register("decode_picture", "zlib", _zlib_decoder)
register("optical_flow", "block", _block_flow)
