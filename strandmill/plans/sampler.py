"""The sampling run: score, threshold, select. One plan serves batch, gated and online scoring, as all state is windowed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators import context, detections, scoring, selection, thresholds
from strandmill.session import durable
from strandmill.streaming.online import online_keep

KEYS = ["video_id", "frame_idx"]


@dataclass
class Run:
    scores: DataFrame
    selection: DataFrame
    richness: DataFrame
    bounds: DataFrame


def score_table(frames: DataFrame, features: DataFrame, motion: DataFrame, cfg: dict, chunk: int | None = 4096) -> DataFrame:
    """Scores of frames (video_id, frame_idx, class_ids as detected), features (.., feat) and motion (.., motion)."""
    s, c, w = cfg["scoring"], cfg["context"], cfg["class_weight"]
    carried = detections.carry_forward(frames.select(*KEYS, "class_ids"), s["score_detector_interval"], cfg["performance"]["reuse_detections"])
    weights = detections.class_weights(carried, w["detector_interval"], w["window_frames"], tuple(w["rare_classes"]))
    near = context.context_measures(features, c["mode"], c["history_frames"], c["context_size"], c["cluster_min_samples"], s["novelty_power"], chunk)
    objects = carried.select(*KEYS, F.size("class_ids").alias("n_objects"))
    return scoring.score_frames(near.join(motion, KEYS).join(weights, KEYS).join(objects, KEYS), cfg)


def gated_table(frames: DataFrame, features: DataFrame, motion: DataFrame, cfg: dict) -> DataFrame:
    """(video_id, frame_idx, score): only frames that pass the motion gate are scored in full, against each other's history."""
    s = cfg["scoring"]
    gate = selection.motion_gate(motion, s["motion_gate_fraction"], s["semantic_floor_interval"])
    chosen = gate.where("candidate").select(*KEYS)
    heavy = score_table(frames, features.join(chosen, KEYS, "left_semi"), motion, cfg, chunk=None)
    return selection.gated_scores(gate, heavy.select(*KEYS, "score"))


def run(frames: DataFrame, features: DataFrame, motion: DataFrame, cfg: dict, chunk: int | None = 4096) -> Run:
    """Scores and the kept set, by cfg's algorithm (batch, online, motion_gated) and retention mode (target_ratio, adaptive, online)."""
    s = cfg["scoring"]
    if s["algorithm"] not in ("batch", "online", "motion_gated"):
        raise ValueError(f"unknown algorithm {s['algorithm']!r}")
    if s["algorithm"] == "motion_gated":
        scores = gated_table(frames, features, motion, cfg)
    else:
        scores = score_table(frames, features, motion, cfg, chunk)
    scores = durable(scores)  # read again by every step of the selection, and by the caller
    if {"n_objects", "motion"} <= set(scores.columns):
        seen = scores.select(*KEYS, "n_objects", "motion")
    else:
        carried = detections.carry_forward(frames.select(*KEYS, "class_ids"), s["score_detector_interval"], cfg["performance"]["reuse_detections"])
        seen = carried.join(motion, KEYS).select(*KEYS, F.size("class_ids").alias("n_objects"), "motion")
    richness = durable(thresholds.clip_richness(seen, cfg))
    bounds = thresholds.retention_bounds(richness, cfg)
    flat = scores.select(*KEYS, "score")
    if s["retention_mode"] == "adaptive":
        kept = selection.adaptive_select(flat, bounds, cfg, s["tau"])
    elif s["retention_mode"] == "target_ratio":
        if s["selection_mode"] == "diverse":
            kept = selection.diverse_topk(flat.join(features, KEYS), s["target_retention_ratio"], s["min_temporal_gap"], s["diversity_sim_penalty"])
            kept = kept.join(thresholds.calibrate_tau(flat, s["target_retention_ratio"]), "video_id")
        else:
            kept = selection.target_ratio(flat, s["target_retention_ratio"])
    else:
        kept = online_keep(flat, s["tau_warmup_frames"], s["target_retention_ratio"]).where("kept").drop("kept")
    return Run(scores, kept, richness, bounds)
