"""Compression and decompression plans over label maps and pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators import codec, imaging, reconstruct
from strandmill.sources import hooks

MODES = ("soft_edge", "hybrid", "rgb_only", "h264_only")


def mode_of(cfg: dict) -> str:
    """Which plan the settings ask for."""
    edge = cfg["soft_edge"]
    if cfg.get("delivery", {}).get("h264_only"):
        return "h264_only"
    if edge.get("rgb_only"):
        return "rgb_only"
    return "hybrid" if edge["rgb_keyframe_interval"] > 0 else "soft_edge"


def compress(frames: DataFrame, cfg: dict, pictures: DataFrame | None = None, raw: DataFrame | None = None) -> DataFrame:
    """(video_id, frame_idx, payload) of label frames (video_id, frame_idx, labels).

    soft_edge codes every frame's edges; hybrid sends each ``rgb_keyframe_interval``-th frame as a coded picture, which
    starts a segment; rgb_only sends those alone. pictures: (video_id, frame_idx, picture), coded already, or raw:
    (video_id, frame_idx, height, width, n_channels, data), which the hook named by codec.picture codes.
    """
    edge, mode = cfg["soft_edge"], mode_of(cfg)
    if mode == "h264_only":
        hooks.lookup("encode_video", "h264")
    keys = int(edge["rgb_keyframe_interval"])
    if mode == "soft_edge":
        return codec.edge_packets(codec.delta_encode(frames, edge["keyframe_interval"]), frames)
    name = cfg.get("codec", {}).get("picture", "zlib")
    if pictures is None and raw is None:
        raise ValueError("key pictures are asked for, but neither coded nor raw pictures are given")
    is_key = F.col("frame_idx") % keys == 0
    if pictures is None:
        kind = raw.schema["frame_idx"].dataType.simpleString()
        pictures = hooks.apply(raw.where(is_key), "encode_picture", name, f"video_id string, frame_idx {kind}, picture binary")
    anchors = codec.key_packets(pictures.where(is_key))
    if mode == "rgb_only":
        return anchors
    between = frames.where(~is_key)
    return anchors.unionByName(codec.edge_packets(codec.delta_encode(between, keys), between))


def decode_keys(packets: DataFrame, name: str = "zlib") -> DataFrame:
    """(video_id, frame_idx, height, width, n_channels, data) of the key packets, by the hook ``name``."""
    rows = codec.unpack_packets(packets).where("tag = 'K'").select("video_id", "frame_idx", "picture")
    kind = rows.schema["frame_idx"].dataType.simpleString()
    return hooks.apply(rows, "decode_picture", name, f"video_id string, frame_idx {kind}, height int, width int, n_channels int, data binary")


def playback(packets: DataFrame, frames: DataFrame, interval: int, name: str = "zlib") -> DataFrame:
    """(video_id, frame_idx, px) of a stream with key pictures, for ``frames`` (video_id, frame_idx): what lies between keys is filled in."""
    px = imaging.to_pixels(decode_keys(packets, name))
    return reconstruct.linear_interpolation(frames.select("video_id", "frame_idx").join(px, ["video_id", "frame_idx"], "left"), interval)


def decompress(packets: DataFrame, interval: int) -> DataFrame:
    """(video_id, frame_idx, labels) of edge packets; the interval comes with the stream."""
    return codec.decode_packets(packets, interval=interval)


def packet_sizes(triples: DataFrame, frames: DataFrame, pixel_bytes: int = 6) -> DataFrame:
    """(video_id, n_frames, pixels, compressed_bytes) before the general-purpose compression."""
    n = frames.groupBy("video_id").agg(F.count("*").alias("n_frames"))
    found = triples.groupBy("video_id").agg(F.count("*").alias("pixels"))
    pixels = F.coalesce("pixels", F.lit(0))
    return n.join(found, "video_id", "left").select("video_id", "n_frames", pixels.alias("pixels"), (pixels * pixel_bytes).alias("compressed_bytes"))


def reconstruction_quality(frames: DataFrame, interval: int) -> DataFrame:
    """(video_id, psnr, ssim): mean quality of frames filled in between keys."""
    filled = reconstruct.linear_interpolation(frames, interval)
    return reconstruct.quality(frames, filled).groupBy("video_id").agg(F.round(F.avg("psnr"), 6).alias("psnr"), F.round(F.avg("ssim"), 6).alias("ssim"))
