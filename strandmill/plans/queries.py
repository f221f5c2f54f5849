"""The query catalogue over the driver's tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions import measures, vector
from strandmill.functions.vocabulary import class_name
from strandmill.operators import baselines, codec, context, detections, imaging, reconstruct, scoring, selection, thresholds, tracking
from strandmill.operators.windows import chunked
from strandmill.plans import combo, compressor, report, sampler
from strandmill.plans.config import config
from strandmill.session import durable, shared_folder
from strandmill.sources import adapters, bitstream, scan
from strandmill.streaming.online import online_keep

KEYS = ["video_id", "frame_idx"]
PALETTE = [(0.0, 0.0, 0.0), (64.0, 32.0, 16.0), (96.0, 160.0, 64.0), (160.0, 96.0, 192.0), (224.0, 200.0, 160.0), (255.0, 255.0, 255.0)]
KEY_INTERVAL, SEGMENT, RATIO = 10, 30, 0.2


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# -- sources

def frame_scan(spark: SparkSession, d: str) -> DataFrame:
    """Strided scan of every video."""
    e = adapters.table(spark, d, "embeddings")
    src = e.select(F.concat(F.lit("v"), F.floor(F.col("vec_id") / adapters.VIDEO_FRAMES).cast("string")).alias("video_id"), (F.col("vec_id") % adapters.VIDEO_FRAMES).alias("src_idx"), "label")
    return scan.scan(src, 2).select("video_id", "frame_idx", "src_idx", "label")


def video_probe(spark: SparkSession, d: str) -> DataFrame:
    """Metadata, frame rate and frame estimates."""
    return report.transmission(adapters.videos(spark, d)).select("video_id", "fps", "frames_estimate")


def kept_frame_scan(spark: SparkSession, d: str) -> DataFrame:
    """Second pass: frames in the kept set."""
    kept = selection.every_kth(adapters.features(spark, d), 7)
    px = adapters.gray_frames(spark, d)
    return selection.kept_frames(px, kept).select(*KEYS, F.array_join("px", ",").alias("px"))


def kept_frame_sink(spark: SparkSession, d: str) -> DataFrame:
    """Kept frames written as raw files, by one task a video, and read back with a stride."""
    folder = f"{urlparse(shared_folder(spark)).path}/raw-{uuid.uuid4().hex}"
    px = adapters.gray_frames(spark, d)
    scan.write_raw(imaging.from_pixels(selection.every_kth(px, 5), 8, 8), folder)
    back = imaging.to_pixels(spark.read.format("raw_frames").option("stride", 2).load(folder))
    return durable(back.select(*KEYS, F.array_join("px", ",").alias("px")))


def materialised_scan(spark: SparkSession, d: str) -> DataFrame:
    """Frames held for two passes: how many there are, and the mean level."""
    held = scan.materialised(adapters.gray_frames(spark, d))
    n, mean = held.groupBy("video_id").agg(F.count("*").alias("n")), held.groupBy("video_id").agg(F.round(F.avg(vector.mean(F.col("px"))), 6).alias("mean_level"))
    out = durable(n.join(mean, "video_id"))
    held.unpersist()
    return out


# -- features and context

def delta_map_h20(spark: SparkSession, d: str) -> DataFrame:
    """Delta map over the last 20 frames."""
    return r6(context.delta_maps(adapters.features(spark, d), 20), "delta_map")


def delta_map_chunked(spark: SparkSession, d: str) -> DataFrame:
    """The same for one long sequence in halo chunks (4.2)."""
    x = adapters.features(spark, d, per_video=1 << 40)
    return r6(context.context_measures(x, "uniform", 20, 20, chunk=64).select(*KEYS, "delta_map", "n_context"), "delta_map")


def novelty_uniform(spark: SparkSession, d: str) -> DataFrame:
    """Uniform context, novelty."""
    x = context.context_measures(adapters.features(spark, d), "uniform", 15, 3)
    return r6(x.select(*KEYS, "delta_map", "novelty", "n_context"), "delta_map", "novelty")


def feature_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Unit norm, cosine similarity and distance to the frame before."""
    x = adapters.features(spark, d).withColumn("feat", vector.unit(F.col("feat")))
    x = chunked(x, 4096, 1, lambda rows, window: rows.withColumn("before", F.lag("feat").over(window)))
    return r6(x.where("before is not null").select(*KEYS, vector.cosine_similarity(F.col("feat"), F.col("before")).alias("similarity"), vector.cosine_distance(F.col("feat"), F.col("before")).alias("distance")), "similarity", "distance")


def oric_proxy(spark: SparkSession, d: str) -> DataFrame:
    """Reward against evenly stepped context."""
    return r6(baselines.stepped_rewards(adapters.features(spark, d)), "score")


def diverse_context(spark: SparkSession, d: str) -> DataFrame:
    """Clustered context."""
    x = context.context_measures(adapters.features(spark, d), "diverse", 20, 4)
    return r6(x.select(*KEYS, "delta_map", "novelty", "n_context"), "delta_map", "novelty")


def semantic_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Kept by delta x novelty with clustered context."""
    return r6(baselines.semantic_ablation(adapters.features(spark, d), RATIO), "score")


# -- motion and pictures

def motion_lag(spark: SparkSession, d: str) -> DataFrame:
    """Instant motion."""
    return r6(scoring.pixel_motion(adapters.gray_frames(spark, d)), "motion")


def motion_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Change in gray levels."""
    return r6(baselines.change(adapters.gray_frames(spark, d)), "motion")


def entropy_hist(spark: SparkSession, d: str) -> DataFrame:
    """Histogram entropy."""
    return r6(baselines.entropy(adapters.gray_frames(spark, d)), "entropy")


def content_aware(spark: SparkSession, d: str) -> DataFrame:
    """Kept by edge density."""
    frames = imaging.from_pixels(adapters.gray_frames(spark, d), 8, 8)
    return r6(selection.top_ratio(frames.select(*KEYS, F.round(imaging.edge_density(), 9).alias("score")), RATIO), "score")


def _listed(frames: DataFrame) -> DataFrame:
    return imaging.to_pixels(frames).withColumn("px", F.array_join("px", ","))


def resize_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames at most 14 high, the width rounded, and whether they were made smaller."""
    x = imaging.resized(imaging.from_pixels(adapters.gray_frames(spark, d), 16, 4), 14)
    return _listed(x).join(x.select(*KEYS, "height", "width", "scaled"), KEYS)


def resize_truncating(spark: SparkSession, d: str) -> DataFrame:
    """The same with the width cut off."""
    x = imaging.resized(imaging.from_pixels(adapters.gray_frames(spark, d), 16, 4), 14, round_width=False)
    return _listed(x).join(x.select(*KEYS, "height", "width"), KEYS)


def gray_thumbnail(spark: SparkSession, d: str) -> DataFrame:
    """Gray levels of BGR pictures, at half size."""
    return imaging.gray_thumbnails(adapters.colour_frames(spark, d), 4, 4).withColumn("px", F.array_join("px", ","))


def rgb_order(spark: SparkSession, d: str) -> DataFrame:
    """BGR to RGB."""
    return _listed(imaging.rgb_frames(adapters.colour_frames(spark, d)))


def dilate_labels(spark: SparkSession, d: str) -> DataFrame:
    """3 x 3 maximum."""
    return imaging.dilated(adapters.label_frames(spark, d), 8, 8).withColumn("labels", F.array_join("labels", ","))


def soft_edge_frames(spark: SparkSession, d: str) -> DataFrame:
    """Edge pixels by their nearest palette entry."""
    return imaging.soft_edges(adapters.colour_frames(spark, d), PALETTE, grow=1).select(*KEYS, F.array_join("labels", ",").alias("labels"))


def _soft(spark: SparkSession, d: str) -> DataFrame:
    """RGB pictures of the label maps in the palette's colours."""
    colour = F.array(*[F.array(*[F.lit(int(v)) for v in c]) for c in [(0.0, 0.0, 0.0), *PALETTE, (32.0, 64.0, 96.0)]])
    px = F.flatten(F.transform("labels", lambda v: F.get(colour, v)))
    return imaging.from_pixels(adapters.label_frames(spark, d).select(*KEYS, px.alias("px")), 8, 8, 3)


def refine_frames(spark: SparkSession, d: str) -> DataFrame:
    """Guide blended in and smoothed, then sharpened."""
    return _listed(imaging.refined(imaging.rgb_frames(adapters.colour_frames(spark, d)), _soft(spark, d), sharpen=0.35))


def fill_frames(spark: SparkSession, d: str) -> DataFrame:
    """Background of soft-edge pictures filled in."""
    return _listed(imaging.filled(_soft(spark, d)))


def baseline_fill(spark: SparkSession, d: str) -> DataFrame:
    """Soft-edge pictures reconstructed without a model, by fast marching."""
    return _listed(imaging.baseline_filled(_soft(spark, d)))


# -- detections and scores

def _grid(spark: SparkSession, d: str) -> DataFrame:
    return adapters.detection_frames(spark, d)


def detection_names(spark: SparkSession, d: str) -> DataFrame:
    """Class lookup, '' out of range."""
    x = _grid(spark, d).select(F.explode("class_ids").alias("class_id")).withColumn("class_id", F.when(F.col("class_id") == 9, F.lit(99)).otherwise(F.col("class_id")))
    return x.groupBy("class_id").agg(F.count("*").alias("n")).withColumn("name", class_name(F.col("class_id")))


def detection_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Detections reused until the next."""
    x = detections.carry_forward(_grid(spark, d), 12)
    return x.select(*KEYS, F.size("class_ids").alias("n_objects"), F.array_join("class_ids", ",").alias("class_ids"))


def class_weight_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Rolling class counts and frame weight."""
    return r6(detections.class_weights(detections.carry_forward(_grid(spark, d), 12)), "class_weight")


def _scored(spark: SparkSession, d: str, cfg: dict) -> DataFrame:
    grid = _grid(spark, d)
    return sampler.score_table(grid, adapters.grid_features(spark, d), scoring.level_motion(grid), cfg)


def score_blend(spark: SparkSession, d: str) -> DataFrame:
    """The full score."""
    return r6(_scored(spark, d, config()), "delta_map", "novelty", "motion", "class_weight", "semantic", "score")


def class_count_map(spark: SparkSession, d: str) -> DataFrame:
    """How often each class is detected, as a map (2.8)."""
    x = _grid(spark, d).select("video_id", F.explode("class_ids").alias("class_id")).groupBy("video_id", "class_id").agg(F.count("*").alias("n"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("class_id").cast("string"), "n"))))
    return x.groupBy("video_id").agg(counts.alias("counts")).select("video_id", F.size("counts").alias("classes"), F.to_json("counts").alias("counts"))


def score_stats(spark: SparkSession, d: str) -> DataFrame:
    """Distribution (A1)."""
    return r6(thresholds.score_stats(adapters.price_scores(spark, d)), "min", "max", "median", "p90", "frac_below_1e4", "frac_above_001")


def calibrate_tau(spark: SparkSession, d: str) -> DataFrame:
    """Threshold by quantile (A2)."""
    return r6(thresholds.calibrate_tau(adapters.price_scores(spark, d), RATIO), "tau")


def adaptive_tau(spark: SparkSession, d: str) -> DataFrame:
    """Threshold by median and MAD (A3)."""
    return r6(thresholds.adaptive_tau(adapters.price_scores(spark, d), config("adaptive_v4")), "tau")


def _seen(spark: SparkSession, d: str, interval: int) -> DataFrame:
    grid = _grid(spark, d)
    held = detections.carry_forward(grid, interval)
    return held.join(scoring.level_motion(grid), KEYS).select(*KEYS, F.size("class_ids").alias("n_objects"), "motion")


def busy_information(spark: SparkSession, d: str) -> DataFrame:
    """Clip richness (A4, A5)."""
    return r6(thresholds.clip_richness(_seen(spark, d, 12), config()), "busy", "information")


def adaptive_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Retention bounds."""
    cfg = config("adaptive_v4")
    return thresholds.retention_bounds(thresholds.clip_richness(_seen(spark, d, 8), cfg), cfg)


# -- selection

def topk_target_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Top share of each video."""
    kept = selection.target_ratio(adapters.price_scores(spark, d), RATIO)
    return r6(kept.withColumn("score", F.round("score", 7)), "tau")


def threshold_keep(spark: SparkSession, d: str) -> DataFrame:
    """Strictly above the threshold."""
    x = adapters.price_scores(spark, d)
    above = x.join(thresholds.calibrate_tau(x, RATIO), "video_id").where(F.col("score") > F.round("tau", 9))
    return above.groupBy("video_id").agg(F.count("*").alias("n"), F.round(F.min("score"), 7).alias("lowest"))


def adaptive_select(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: score, adapt, select."""
    grid = _grid(spark, d)
    out = sampler.run(grid, adapters.grid_features(spark, d), scoring.level_motion(grid), config(scoring={"retention_mode": "adaptive"}))
    return r6(out.selection.select("video_id", "frame_idx", "score", "tau"), "score", "tau")


def adaptive_v4_run(spark: SparkSession, d: str) -> DataFrame:
    """The adaptive preset from end to end: clustered context, richness, bounds, threshold."""
    grid = _grid(spark, d)
    out = sampler.run(grid, adapters.grid_features(spark, d), scoring.level_motion(grid), config("adaptive_v4"))
    return r6(out.selection.select("video_id", "frame_idx", "score", "tau"), "score", "tau")


def motion_gate(spark: SparkSession, d: str) -> DataFrame:
    """Gate, and scores with motion for the rest."""
    gate = selection.motion_gate(scoring.pixel_motion(adapters.gray_frames(spark, d)))
    x = context.delta_maps(adapters.features(spark, d), 20).select(*KEYS, F.round("delta_map", 9).alias("score"))
    both = selection.gated_scores(gate, x).join(gate.select(*KEYS, "candidate"), KEYS)
    return r6(both, "score")


def gated_sampling(spark: SparkSession, d: str) -> DataFrame:
    """The whole motion-gated run."""
    grid = _grid(spark, d)
    out = sampler.run(grid, adapters.grid_features(spark, d), scoring.level_motion(grid), config("light"))
    return r6(out.selection, "score", "tau")


def uniform_keep(spark: SparkSession, d: str) -> DataFrame:
    """One of k (T6)."""
    return selection.every_kth(adapters.features(spark, d), 5).select(*KEYS)


def non_uniform_keep(spark: SparkSession, d: str) -> DataFrame:
    """Motion and entropy."""
    return r6(baselines.non_uniform(adapters.gray_frames(spark, d), RATIO), "score")


def gap_topk(spark: SparkSession, d: str) -> DataFrame:
    """Score order with a least gap (T5)."""
    return r6(selection.gap_topk(baselines.non_uniform_scores(adapters.gray_frames(spark, d)), 0.3), "score")


def diverse_topk(spark: SparkSession, d: str) -> DataFrame:
    """Greedy diverse choice (T4)."""
    x = baselines.non_uniform_scores(adapters.gray_frames(spark, d)).join(adapters.features(spark, d), KEYS)
    return r6(selection.diverse_topk(x, RATIO), "score")


def kept_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two kept sets (2.7)."""
    px = adapters.gray_frames(spark, d)
    return selection.overlap(baselines.non_uniform(px, RATIO), selection.every_kth(px, 5))


def online_selection(spark: SparkSession, d: str) -> DataFrame:
    """Warm-up, then a fixed threshold."""
    return r6(online_keep(baselines.non_uniform_scores(adapters.gray_frames(spark, d)), warmup=30), "score", "tau")


# -- codec

def delta_encode(spark: SparkSession, d: str) -> DataFrame:
    """Changed pixels."""
    return codec.delta_encode(adapters.label_frames(spark, d), SEGMENT)


def delta_decode(spark: SparkSession, d: str) -> DataFrame:
    """Packets of the soft-edge mode written, read and decoded; equals the source."""
    frames = adapters.label_frames(spark, d)
    coded = compressor.compress(frames, {"soft_edge": {"rgb_keyframe_interval": 0, "keyframe_interval": SEGMENT}})
    return compressor.decompress(coded, SEGMENT).select(*KEYS, F.array_join("labels", ",").alias("labels"))


def _stream(spark: SparkSession, d: str, **edge) -> DataFrame:
    cfg = {"soft_edge": {"rgb_keyframe_interval": KEY_INTERVAL, "keyframe_interval": SEGMENT, **edge}}
    return compressor.compress(adapters.label_frames(spark, d), cfg, raw=imaging.from_pixels(adapters.gray_frames(spark, d), 8, 8))


def hybrid_stream(spark: SparkSession, d: str) -> DataFrame:
    """Key pictures and the edges between them, coded, read and decoded."""
    coded = durable(_stream(spark, d))
    keys = imaging.to_pixels(compressor.decode_keys(coded)).select(*KEYS, F.lit("K").alias("tag"), F.array_join("px", ",").alias("content"))
    return keys.unionByName(compressor.decompress(coded, KEY_INTERVAL).select(*KEYS, F.lit("E").alias("tag"), F.array_join("labels", ",").alias("content")))


def rgb_only_playback(spark: SparkSession, d: str) -> DataFrame:
    """A stream of key pictures alone, played with what lies between filled in."""
    return compressor.playback(_stream(spark, d, rgb_only=True), adapters.gray_frames(spark, d), KEY_INTERVAL).select(*KEYS, F.array_join("px", ",").alias("px"))


def flow_playback(spark: SparkSession, d: str) -> DataFrame:
    """Frames between keys by motion compensation."""
    return _listed(imaging.flow_interpolation(imaging.from_pixels(adapters.gray_frames(spark, d), 8, 8), KEY_INTERVAL))


def hybrid_blend(spark: SparkSession, d: str) -> DataFrame:
    """Frames mixed with their last key."""
    px = adapters.gray_frames(spark, d)
    keys = px.where(F.col("frame_idx") % KEY_INTERVAL == 0)
    return reconstruct.hybrid_blend(px, keys, KEY_INTERVAL, 0.25).select(*KEYS, F.array_join("px", ",").alias("px"))


def residual_blend(spark: SparkSession, d: str) -> DataFrame:
    """Filled-in frames moved towards a model's output; the source stands in for the model."""
    px = adapters.gray_frames(spark, d)
    return reconstruct.residual_blend(reconstruct.linear_interpolation(px, KEY_INTERVAL), px, 0.25).select(*KEYS, F.array_join("px", ",").alias("px"))


def _combo(spark: SparkSession, d: str):
    kept = baselines.non_uniform(adapters.gray_frames(spark, d), RATIO)
    return combo.run_combo(adapters.label_frames(spark, d), kept, {"soft_edge": {"rgb_keyframe_interval": 0, "keyframe_interval": SEGMENT}}, 64)


def combo_report(spark: SparkSession, d: str) -> DataFrame:
    """Sampling and coding in one run: sizes, savings, transmission."""
    return _combo(spark, d).report


def combo_decoded(spark: SparkSession, d: str) -> DataFrame:
    """What that run's stream decodes to."""
    return _combo(spark, d).decoded.select(*KEYS, "src_idx", F.array_join("labels", ",").alias("labels"))


def compression_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of videos that are coded in part, against their share of the file."""
    frames = adapters.label_frames(spark, d)
    sizes = compressor.packet_sizes(codec.delta_encode(frames, SEGMENT), frames)
    videos = sizes.select("video_id", F.lit(120).alias("frame_count"), (F.col("n_frames") * 997).alias("size_bytes"))
    return report.compression_summary(videos, sizes.select("video_id", "n_frames", "compressed_bytes"))


def packet_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Coded sizes."""
    frames = adapters.label_frames(spark, d)
    return compressor.packet_sizes(codec.delta_encode(frames, SEGMENT), frames)


def bitstream_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Bitstream files written and read."""
    frames = adapters.label_frames(spark, d)
    coded = codec.edge_packets(codec.delta_encode(frames, SEGMENT), frames)
    back = bitstream.packets(bitstream.bitstreams(coded, PALETTE, SEGMENT))
    return back.select(*KEYS, F.hex("payload").alias("payload"), "interval")


def storage_downscale(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-source label maps at half size."""
    return codec.storage_downscale(adapters.label_frames(spark, d), 2).select(*KEYS, F.array_join("labels", ",").alias("labels"))


def palette_assign(spark: SparkSession, d: str) -> DataFrame:
    """Nearest colour and its levels."""
    x = adapters.gray_frames(spark, d).select(*KEYS, F.posexplode(adapters.colours()).alias("p", "c"))
    x = x.select(*KEYS, "p", *[F.col(f"c.{n}").cast("double").alias(n) for n in "rgb"])
    return codec.soft_colours(codec.assign_palette(x, PALETTE), PALETTE).select(*KEYS, "p", "label", "soft_r", "soft_g", "soft_b")


def palette_fit(spark: SparkSession, d: str) -> DataFrame:
    """A palette by k-means."""
    x = adapters.gray_frames(spark, d).select(F.explode(adapters.colours()).alias("c")).select(*[F.col(f"c.{n}").cast("double").alias(n) for n in "rgb"])
    return spark.createDataFrame([(k, *c) for k, c in enumerate(codec.fit_palette(x))], "cluster int, r double, g double, b double")


# -- reconstruction and reports

def key_interp_linear(spark: SparkSession, d: str) -> DataFrame:
    """Frames between keys."""
    return reconstruct.linear_interpolation(adapters.gray_frames(spark, d), KEY_INTERVAL).select(*KEYS, F.array_join("px", ",").alias("px"))


def psnr_ssim(spark: SparkSession, d: str) -> DataFrame:
    """Quality of the filled frames."""
    px = adapters.gray_frames(spark, d)
    return r6(reconstruct.quality(px, reconstruct.linear_interpolation(px, KEY_INTERVAL)), "psnr", "ssim")


def ssim_windowed(spark: SparkSession, d: str) -> DataFrame:
    """Structural similarity over 7 x 7 windows (P25)."""
    px = adapters.gray_frames(spark, d)
    return r6(imaging.windowed_ssim(imaging.from_pixels(px, 8, 8), imaging.from_pixels(reconstruct.linear_interpolation(px, KEY_INTERVAL), 8, 8)), "ssim")


def mean_quality(spark: SparkSession, d: str) -> DataFrame:
    """Mean quality a video."""
    return compressor.reconstruction_quality(adapters.gray_frames(spark, d), KEY_INTERVAL)


def temporal_stack(spark: SparkSession, d: str) -> DataFrame:
    """The last three label maps, padded in front."""
    return reconstruct.temporal_stack(adapters.label_frames(spark, d), 3).select(*KEYS, F.array_join(F.flatten("stack"), ",").alias("stack"))


def ema_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Recursive smoothing."""
    return reconstruct.temporal_smooth(adapters.gray_frames(spark, d)).select(*KEYS, F.array_join("px", ",").alias("px"))


def tx_time_report(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, savings, modelled transmission."""
    return report.transmission(adapters.videos(spark, d)).drop("fps", "frames_estimate")


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Manifest of a kept set (K4)."""
    px = adapters.gray_frames(spark, d)
    rows = report.manifest(baselines.non_uniform(px, RATIO), px.groupBy("video_id").agg(F.count("*").alias("n")), "non_uniform")
    return r6(rows.withColumn("indices", F.array_join("indices", ",")), "retention_ratio")


def manifest_json(spark: SparkSession, d: str) -> DataFrame:
    """The manifest as JSON (K4, K5)."""
    px = adapters.gray_frames(spark, d)
    return report.as_json(report.manifest(baselines.non_uniform(px, RATIO), px.groupBy("video_id").agg(F.count("*").alias("n")), "non_uniform"))


def debug_overlay(spark: SparkSession, d: str) -> DataFrame:
    """State of every frame (K3)."""
    px = adapters.gray_frames(spark, d)
    s = baselines.non_uniform_scores(px)
    return report.overlay(px, s, selection.top_ratio(s, RATIO)).select(*KEYS, "state", "caption")


# -- traffic

def traffic_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that count, on kept frames."""
    b = adapters.boxes(spark, d)
    return tracking.traffic_boxes(b, b.select(*KEYS).distinct().where("frame_idx % 2 = 0")).groupBy("video_id", "class_id").agg(F.count("*").alias("n"))


def box_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each box with the one before it in its frame (2.8 geometry)."""
    before = F.lag("box").over(Window.partitionBy(*KEYS).orderBy("det", "box"))  # det numbers repeat
    x = adapters.boxes(spark, d).withColumn("before", before).where("before is not null")
    return r6(x.select("video_id", "det", measures.iou(F.col("box"), F.col("before")).alias("iou")), "iou")


def tracker(spark: SparkSession, d: str) -> DataFrame:
    """Tracks (R8, J7)."""
    return r6(tracking.track(tracking.traffic_boxes(adapters.boxes(spark, d))), "speed")


def traffic_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Every second frame against all."""
    b = tracking.traffic_boxes(adapters.boxes(spark, d))
    whole, half = (tracking.traffic_stats(tracking.track(x)) for x in (b, b.where("frame_idx % 2 = 0")))
    return r6(tracking.compare_traffic(whole, half), "id_retention_pct", "avg_speed_error_pct", "max_speed_error_pct")


QUERIES = (
    frame_scan, video_probe, kept_frame_scan, kept_frame_sink, materialised_scan, delta_map_h20, delta_map_chunked, novelty_uniform, feature_similarity, oric_proxy, diverse_context,
    semantic_ablation, motion_lag, motion_baseline, entropy_hist, content_aware, resize_frames, resize_truncating, gray_thumbnail, rgb_order, dilate_labels, soft_edge_frames,
    refine_frames, fill_frames, baseline_fill, detection_names, detection_carry_forward, class_weight_rolling, score_blend, class_count_map, score_stats, calibrate_tau, adaptive_tau, busy_information,
    adaptive_bounds, topk_target_ratio, threshold_keep, adaptive_select, adaptive_v4_run, motion_gate, gated_sampling, uniform_keep, non_uniform_keep, gap_topk, diverse_topk,
    kept_overlap, online_selection, delta_encode, delta_decode, hybrid_stream, rgb_only_playback, flow_playback, hybrid_blend, residual_blend, combo_report, combo_decoded, compression_summary, packet_sizes, bitstream_round_trip,
    storage_downscale, palette_assign, palette_fit, key_interp_linear, psnr_ssim, ssim_windowed, mean_quality, temporal_stack, ema_smooth, tx_time_report, manifest, manifest_json,
    debug_overlay, traffic_boxes, box_overlap, tracker, traffic_fidelity,
)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}
