"""Configuration: defaults, presets and policies. Unknown keys are errors."""

from __future__ import annotations

import copy
import json
from typing import Any

#: The default settings.
DEFAULT: dict[str, dict[str, Any]] = {
    "video": {"max_frames": None, "frame_stride": 2, "max_height": 720},
    "performance": {"stream_frames": True, "embed_batch_size": 32, "embed_input_size": 192, "use_fp16": True, "yolo_half": True, "yolo_imgsz": 384, "reuse_detections": True, "skip_input_clip": True, "fast_mode": False},
    "embedding": {"backbone": "mobilenet_v3_small", "embed_dim": 576, "device": None},
    "context": {"mode": "uniform", "history_frames": 15, "context_size": 3, "cluster_min_samples": 3},
    "class_weight": {"window_frames": 60, "detector_interval": 10, "yolo_model": "yolov8n.pt", "rare_classes": ["person", "bicycle", "motorcycle", "bus", "truck"]},
    "scoring": {
        "algorithm": "batch", "retention_mode": "target_ratio", "tau": None, "target_retention_ratio": 0.2, "tau_warmup_frames": 120, "novelty_power": 1.0, "min_score": 0.0,
        "selection_mode": "threshold", "min_temporal_gap": 4, "diversity_sim_penalty": 0.45, "score_detector_interval": 12, "detection_score_boost": 0.12, "motion_blend": 0.35,
        "vehicle_presence_floor": 0.2, "busy_objects_threshold": 2, "busy_motion_threshold": 0.025, "busy_score_floor": 0.35, "busy_score_boost": 0.15, "motion_gate_fraction": 0.35, "semantic_floor_interval": 6,
    },
    "adaptive": {
        "traffic_aware": True, "information_aware": False, "mad_multiplier": 1.2, "min_tau_quantile": 0.45, "flat_quantile": 0.68, "soft_target_retention": 0.35,
        "busy_soft_retention_cap": 0.62, "busy_min_retention_floor": 0.38, "min_retention_ratio": 0.12, "max_retention_ratio": 0.70,
    },
    "paths": {"output_dir": "outputs"},
}

#: Presets over the defaults.
PRESETS: dict[str, dict[str, dict[str, Any]]] = {
    "fast": {
        "video": {"frame_stride": 2, "max_height": 720},
        "performance": {"stream_frames": True, "embed_batch_size": 16, "yolo_imgsz": 416, "skip_input_clip": True, "fast_mode": True},
        "context": {"history_frames": 15, "context_size": 3},
        "class_weight": {"detector_interval": 10},
        "scoring": {"score_detector_interval": 8, "selection_mode": "threshold"},
    },
    "quality": {
        "video": {"frame_stride": 1, "max_height": 0},
        "performance": {"stream_frames": False, "embed_batch_size": 1, "embed_input_size": 224, "use_fp16": False, "yolo_imgsz": 640, "reuse_detections": False, "skip_input_clip": False, "fast_mode": False},
        "context": {"mode": "diverse"},
        "class_weight": {"detector_interval": 5},
        "scoring": {"algorithm": "batch", "selection_mode": "diverse", "score_detector_interval": 1},
    },
    "turbo": {
        "video": {"frame_stride": 3, "max_height": 540},
        "performance": {"embed_batch_size": 48, "embed_input_size": 160, "yolo_imgsz": 320, "reuse_detections": True},
        "scoring": {"score_detector_interval": 16},
        "class_weight": {"detector_interval": 16},
    },
    "light": {"scoring": {"algorithm": "motion_gated", "motion_gate_fraction": 0.35, "semantic_floor_interval": 6}, "context": {"mode": "uniform"}},
    "adaptive_v4": {
        "performance": {"stream_frames": True, "yolo_imgsz": 416, "skip_input_clip": False},
        "embedding": {"backbone": "efficientnet_b0", "embed_dim": 1280},
        "context": {"mode": "diverse", "history_frames": 20, "context_size": 4, "cluster_min_samples": 3},
        "class_weight": {"yolo_model": "yolov8s.pt", "detector_interval": 8},
        "scoring": {
            "algorithm": "online", "retention_mode": "adaptive", "busy_objects_threshold": 3, "score_detector_interval": 8, "detection_score_boost": 0.15, "vehicle_presence_floor": 0.25,
            "busy_score_floor": 0.40, "busy_score_boost": 0.18,
        },
        "adaptive": {
            "traffic_aware": True, "information_aware": True, "mad_multiplier": 1.0, "flat_quantile": 0.72, "min_retention_ratio": 0.15, "max_retention_ratio": 0.85,
            "soft_target_retention": 0.30, "busy_soft_retention_cap": 0.82, "busy_min_retention_floor": 0.55,
        },
    },
}
#: A preset goes on top of those named here; the fixed-ratio policy is the adaptive one's models with another selection.
BASES = {"turbo": ("fast",), "light": ("fast",)}

#: The compressor's settings.
COMPRESS: dict[str, dict[str, Any]] = {
    "video": {"max_frames": None, "frame_stride": 1},
    "soft_edge": {"canny_low": 60, "canny_high": 150, "num_clusters": 8, "global_palette": True, "keyframe_interval": 90, "storage_downscale": 8, "rgb_keyframe_interval": 0, "edge_dilate": 0},
    "processing": {"max_height": 720, "edge_max_height": 360},
    "codec": {"zlib_level": 1, "picture": "zlib"},
    "delivery": {"h264_annex": True, "h264_crf": 28, "h264_preset": "fast", "h264_max_height": 720},
    "transmit": {"extra_crf": 2, "h264_crf": None},
    "decompress": {"playback": "h264_annex"},
    "paths": {"output_dir": "outputs"},
}


def merge(base: dict, over: dict, known: dict | None = None, at: str = "") -> dict:
    """``over`` laid over ``base``, section by section; keys that ``known`` lacks are errors, those with a leading _ are passed over."""
    known, out = DEFAULT if known is None else known, copy.deepcopy(base)
    for key, value in over.items():
        if key.startswith("_"):
            continue
        if key not in known:
            raise KeyError(f"unknown setting {at}{key}")
        if isinstance(known[key], dict):
            if not isinstance(value, dict):
                raise TypeError(f"setting {at}{key} is a section")
            out[key] = merge(out.get(key, {}), value, known[key], f"{at}{key}.")
        else:
            out[key] = value
    return out


def config(*presets: str, **sections: dict) -> dict:
    """The defaults with presets laid over in order, then single sections."""
    out = copy.deepcopy(DEFAULT)
    for name in presets:
        if name not in PRESETS:
            raise FileNotFoundError(f"unknown preset {name!r}")
        for layer in (*BASES.get(name, ()), name):
            out = merge(out, PRESETS[layer])
    return merge(out, sections)


def fixed_policy(ratio: float = 0.2) -> dict:
    """The adaptive policy's models and scores with a fixed share kept."""
    return merge(config("adaptive_v4"), {"scoring": {"retention_mode": "target_ratio", "target_retention_ratio": ratio}})


def load(path: str, known: dict | None = None) -> dict:
    """Settings of a YAML or JSON file over the defaults."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        over = json.loads(text)
    except ValueError:
        import yaml

        over = yaml.safe_load(text)
    base = DEFAULT if known is None else known
    return merge(base, over or {}, base)
