"""Operators without SQL against plain loops, and the edge cases of the fixtures."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmill.operators import codec, context, detections, imaging, reconstruct, scoring, selection, tracking
from strandmill.operators.windows import frame_window, history
from strandmill.plans import compressor, config as settings_, report, sampler
from strandmill.sources import adapters, bitstream, hooks, scan
from strandmill.streaming.online import Decider, online_keep


@given(st.lists(st.floats(0, 1, width=32), min_size=1, max_size=60), st.integers(1, 20), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_gap_picks(values, keep, gap):
    s, keep = np.array(values), min(keep, len(values))
    got = selection.gap_picks(s, keep, gap)
    order = sorted(range(len(s)), key=lambda i: (-s[i], i))
    want = []
    for i in order:
        if len(want) < keep and all(abs(i - j) >= gap for j in want):
            want.append(i)
    want += [i for i in order if i not in want][: keep - len(want)]
    assert got == sorted(want)


@given(st.integers(0, 1000))
@settings(max_examples=20, deadline=None)
def test_diverse_picks(seed):
    rng = np.random.default_rng(seed)
    n, gap = 40, 4
    s, x = rng.random(n), rng.normal(size=(n, 5))
    keep, chosen, g = 8, [], gap
    while len(chosen) < keep:
        best = None
        for i in range(n):
            if i in chosen or any(abs(i - j) < g for j in chosen):
                continue
            v = s[i] - (0.45 * max(float(x[i] @ x[j]) for j in chosen) if chosen else 0)
            if best is None or v > best[0] + 1e-12:
                best = (v, i)
        if best is None:
            g -= 1
            continue
        chosen.append(best[1])
    assert selection.diverse_picks(s, keep, x, gap) == sorted(chosen)


def test_uniform_context_places(spark):
    rows = spark.createDataFrame([(n, list(range(n))) for n in (0, 2, 3, 14, 15)], "n int, past array<int>")
    got = {r[0]: r[1] for r in rows.select("n", context.uniform_context(F.col("past"), 3)).collect()}
    assert got == {0: [], 2: [0, 1], 3: [0, 1, 2], 14: [0, 6, 12], 15: [0, 7, 14]}


def test_chunked_equals_whole(spark, sf_dir):
    x = adapters.features(spark, sf_dir, per_video=1 << 40)
    a = context.context_measures(x, chunk=40).orderBy("frame_idx").collect()
    assert a == context.context_measures(x, chunk=None).orderBy("frame_idx").collect()


def test_diverse_context_is_a_partition_of_history():
    x = np.array([[0, 0], [0, 0.1], [5, 5], [5, 5.1], [9, 0]], float)
    reps, centers = context.diverse_context(x, 3)
    assert sorted(reps) == [0, 2, 4] and len(centers) == 3
    assert context.diverse_context(x[:0], 3)[0] == [] and context.diverse_context(x[:1], 3)[0] == [0]


def test_detections_loop(spark, sf_dir):
    grid = adapters.detection_frames(spark, sf_dir)
    got = {(r[0], r[1]): r[2] for r in detections.class_weights(detections.carry_forward(grid, 12)).collect()}
    rare, names = {1, 3}, grid.collect()
    for video in sorted({r["video_id"] for r in names})[:3]:
        last, seen = [], []
        for r in sorted((r for r in names if r["video_id"] == video), key=lambda r: r["frame_idx"]):
            t = r["frame_idx"]
            last = r["class_ids"] if t % 12 == 0 else last
            if t % 10 == 0:
                seen = [*seen, last][-60:]
            counts = [c for o in seen for c in o]
            want = max([1 / np.log(counts.count(c) + 2) * (1.25 if c in rare else 1) for c in last], default=1.0)
            assert got[video, t] == pytest.approx(want)


def test_empty_detection_is_carried(spark):
    rows = [("v", 0, [2, 2]), ("v", 1, []), ("v", 8, []), ("v", 9, [7]), ("v", 16, [1])]
    got = detections.carry_forward(spark.createDataFrame(rows, "video_id string, frame_idx int, class_ids array<int>"), 8)
    assert {r[1]: r[2] for r in got.select("video_id", "frame_idx", "class_ids").collect()} == {0: [2, 2], 1: [2, 2], 8: [], 9: [], 16: [1]}


def test_tracker_loop(spark):
    rng = np.random.default_rng(5)
    boxes = [("v", int(f), d, float(x), float(y), float(x + 20), float(y + 20)) for d, (f, x, y) in enumerate(zip(np.sort(rng.integers(0, 80, 200)), rng.integers(0, 120, 200), rng.integers(0, 120, 200)))]
    df = spark.createDataFrame(boxes, "video_id string, frame_idx int, det long, x1 double, y1 double, x2 double, y2 double").withColumn("box", F.struct("x1", "y1", "x2", "y2"))
    got = {r["det"]: (r["track_id"], r["speed"]) for r in tracking.track(df).collect()}
    tracks = {}
    for _, f, d, x1, y1, x2, y2 in boxes:
        cx, cy, best = (x1 + x2) / 2, (y1 + y2) / 2, (None, 0.0)
        for t, (tx, ty, last) in tracks.items():
            if f - last > 30:
                continue
            w, h = max(0, 20 - abs(cx - tx)), max(0, 20 - abs(cy - ty))
            iou = w * h / (800 - w * h + 1e-8)
            if iou > best[1] and iou >= 0.25:
                best = (t, iou)
        t, speed = best[0], None
        if t is None:
            t = len(tracks) + 1
        elif tracks[t][2] < f:
            speed = np.hypot(cx - tracks[t][0], cy - tracks[t][1]) / ((f - tracks[t][2]) / 30)
        tracks[t] = (cx, cy, f)
        assert got[d][0] == t
        assert (got[d][1] is None) == (speed is None) and (speed is None or got[d][1] == pytest.approx(speed))


def test_online_batch_equals_loop_and_order(spark):
    rng = np.random.default_rng(1)
    s = rng.random(90).tolist()
    df = spark.createDataFrame([("v", i, x) for i, x in enumerate(s)], "video_id string, frame_idx int, score double").orderBy(F.rand(3))
    got = [r["kept"] for r in online_keep(df, 30, 0.25).orderBy("frame_idx").collect()]
    want, warm, tau = [], [], None
    for x in s:
        if tau is None:
            warm.append(x)
            if len(warm) >= 30:
                tau = np.quantile(warm, 0.75)
        want.append(bool(x > tau) if tau is not None else bool(x >= np.median(warm)))
    assert got == want


def test_streaming_equals_batch(spark, tmp_path):
    from strandmill.streaming.online import online_keep_stream

    rng = np.random.default_rng(2)
    src, out = tmp_path / "in", tmp_path / "out"
    for k in range(3):
        pdf = pd.DataFrame({"video_id": ["a", "b"] * 20, "frame_idx": np.repeat(np.arange(20) + 20 * k, 2), "score": rng.random(40)})
        spark.createDataFrame(pdf).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("video_id string, frame_idx long, score double").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = online_keep_stream(stream, 25, 0.3).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = ["video_id", "frame_idx"]
    a = spark.read.parquet(str(out)).select(*key, "kept").orderBy(*key).collect()
    files = spark.read.parquet(str(src))
    assert [tuple(r) for r in a] == [tuple(r) for r in online_keep(files, 25, 0.3).select(*key, "kept").orderBy(*key).collect()]


def test_late_frames_are_dropped():
    d = Decider(5, 0.2)
    d.step(pd.DataFrame({"video_id": ["v"], "frame_idx": [7], "score": [0.5]}))
    assert len(d.step(pd.DataFrame({"video_id": ["v"] * 2, "frame_idx": [3, 8], "score": [0.1, 0.2]}))) == 1


@given(st.lists(st.lists(st.integers(0, 7), min_size=64, max_size=64), min_size=1, max_size=8), st.integers(1, 4))
@settings(max_examples=5, deadline=None)
def test_codec_round_trip(spark, maps, interval):
    frames = spark.createDataFrame([("v", i, m) for i, m in enumerate(maps)], "video_id string, frame_idx int, labels array<int>")
    coded = compressor.compress(frames, {"soft_edge": {"rgb_keyframe_interval": 0, "keyframe_interval": interval}})
    back = compressor.decompress(coded, interval).orderBy("frame_idx").collect()
    assert [r["labels"] for r in back] == maps


def test_hybrid_keys_start_segments(spark):
    maps = [[i % 3] * 64 for i in range(8)]
    frames = spark.createDataFrame([("v", i, m) for i, m in enumerate(maps)], "video_id string, frame_idx int, labels array<int>")
    pictures = frames.select("video_id", "frame_idx", F.encode(F.lit("jpeg"), "utf-8").alias("picture"))
    coded = compressor.compress(frames, {"soft_edge": {"rgb_keyframe_interval": 4, "keyframe_interval": 90}}, pictures)
    rows = codec.unpack_packets(coded)
    assert {(r["frame_idx"], bytes(r["picture"])) for r in rows.where("tag = 'K'").collect()} == {(0, b"jpeg"), (4, b"jpeg")}
    back = {r["frame_idx"]: r["labels"] for r in compressor.decompress(coded, 4).collect()}
    assert back == {i: maps[i] for i in (1, 2, 3, 5, 6, 7)}


def test_removed_pixel_and_bad_tag(spark):
    frames = spark.createDataFrame([("v", 0, [1, 0, 0, 0]), ("v", 1, [0, 0, 2, 0])], "video_id string, frame_idx int, labels array<int>")
    got = {tuple(r)[1:] for r in codec.delta_encode(frames, 30, 2).collect()}
    assert got == {(0, 0, 0, 1), (1, 0, 0, 0), (1, 1, 0, 2)}
    bad = spark.createDataFrame([("v", 0, bytearray(b"Z"))], "video_id string, frame_idx int, payload binary")
    with pytest.raises(Exception, match="unknown packet tag"):
        codec.unpack_packets(bad).collect()


def test_bitstream_bytes():
    head, palette, parts, annex = bitstream.from_bytes(bitstream.to_bytes({"version": 3}, [(1, 2, 3)], [b"", b"E123", b"K"], 17, annex=b"mp4"))
    assert (head["keyframe_interval"], head["version"], parts, annex) == (17, 3, [b"", b"E123", b"K"], b"mp4")
    assert palette.tolist() == [[1, 2, 3]]


def test_bitstream_files(spark, tmp_path):
    (tmp_path / "clip.seccomp").write_bytes(bitstream.to_bytes({}, [(0, 0, 0)], [b"E", b""], 5))
    got = bitstream.read_bitstreams(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [(r["video_id"], r["frame_idx"], bytes(r["payload"]), r["interval"]) for r in got] == [("clip", 0, b"E", 5), ("clip", 1, b"", 5)]


def test_smooth_loop(spark, sf_dir):
    frames = adapters.gray_frames(spark, sf_dir).where("video_id = 'v1' and frame_idx < 40")
    got = [r["px"] for r in reconstruct.temporal_smooth(frames).orderBy("frame_idx").collect()]
    past, last = [], None
    for r, g in zip(frames.orderBy("frame_idx").collect(), got):
        px = np.array(r["px"], np.float32)
        past = [*past, px][-3:]
        if len(past) > 1:
            acc = past[0]
            for p in past[1:]:
                acc = acc * np.float32(0.55) + p * np.float32(0.45)
            px = np.clip(acc, 0, 255).astype(np.uint8).astype(np.float32)
        if last is not None:
            s = np.float32(min(0.3 * (1.2 if r["frame_idx"] % 30 == 0 else 1), 0.52))
            px = np.clip(px * (1 - s) + last * s, 0, 255).astype(np.uint8).astype(np.float32)
        last = px
        assert g == px.astype(int).tolist()


def test_identical_pictures(spark, sf_dir):
    px = adapters.gray_frames(spark, sf_dir).limit(5)
    assert {(r["psnr"], round(r["ssim"], 9)) for r in reconstruct.quality(px, px).collect()} == {(99.0, 1.0)}


def test_imaging():
    img = np.zeros((20, 20, 1), np.uint8)
    img[5:15, 5:15] = 200
    e = imaging.edges(img[:, :, 0], 50, 150)
    assert e[5:15, 5:15].any() and not e[8:12, 8:12].any() and not e[:3].any()
    assert imaging.dilate(np.eye(5, dtype=np.uint8))[0, 1] == 1
    assert imaging.area_resize(img, 10, 10).max() == 200 and imaging.area_resize(img, 20, 20).tolist() == img.tolist()
    assert imaging.limited_size(1080, 1919, 720) == (720, 1279) and imaging.limited_size(1080, 1921, 720, False) == (720, 1280)
    assert imaging.limited_size(100, 50, 0) == (100, 50)
    rgb = np.random.default_rng(0).integers(0, 255, (12, 12, 3)).astype(np.uint8)
    assert imaging.light_sharpen(rgb, rgb, 0) is rgb and imaging.light_sharpen(rgb, rgb).shape == rgb.shape
    assert imaging.post_refine(np.full((6, 6, 3), 9, np.uint8), np.zeros((6, 6, 3), np.uint8)).tolist() == np.full((6, 6, 3), 9).tolist()
    soft = np.zeros((5, 5, 3), np.uint8)
    soft[2, 2] = 90
    assert (imaging.fill_background(soft) == 90).all()
    still = imaging.flow_interpolate(rgb, rgb, np.zeros((12, 12, 2)), 0.5)
    assert np.abs(still.astype(int) - rgb).max() <= 1


def test_soft_edges_and_resize(spark):
    img = np.zeros((8, 8, 3), np.uint8)
    img[2:6, 2:6] = (10, 20, 250)
    frames = spark.createDataFrame([("v", 0, 8, 8, 3, bytearray(img.tobytes()))], "video_id string, frame_idx int, height int, width int, n_channels int, data binary")
    labels = imaging.soft_edges(frames, [(0, 0, 0), (250, 20, 10)], 20, 60).first()["labels"]
    assert set(labels) <= {0, 1, 2} and 2 in labels
    small = imaging.resized(frames, 4).first()
    assert (small["height"], small["width"], small["scaled"], len(small["data"])) == (4, 4, True, 48)


def test_raw_frames(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"height": 1, "width": 2, "n_channels": 1}')
    (tmp_path / "a.raw").write_bytes(bytes(range(20)))
    spark.dataSource.register(scan.RawFrames)
    got = spark.read.format("raw_frames").option("stride", 3).option("max_frames", 3).load(str(tmp_path)).orderBy("frame_idx").collect()
    assert [(r["frame_idx"], r["src_idx"], bytes(r["data"])) for r in got] == [(0, 0, b"\0\1"), (1, 3, b"\6\7"), (2, 6, b"\x0c\x0d")]


def test_hooks_are_loud(spark):
    with pytest.raises(NotImplementedError):
        hooks.lookup("embed", "resnet18")
    with pytest.raises(ValueError):
        hooks.lookup("embed", "nothing")
    hooks.register("detect", "all_cars", lambda: lambda rows: pd.DataFrame({"video_id": rows["video_id"], "class_id": 2}))
    got = hooks.apply(spark.createDataFrame([("v", 1)], "video_id string, frame_idx int"), "detect", "all_cars", "video_id string, class_id int")
    assert got.collect()[0]["class_id"] == 2


def test_config():
    cfg = settings_.config("turbo")
    assert (cfg["video"]["frame_stride"], cfg["performance"]["yolo_imgsz"], cfg["performance"]["fast_mode"]) == (3, 320, True)
    assert settings_.config("quality")["context"] == {"mode": "diverse", "history_frames": 15, "context_size": 3, "cluster_min_samples": 3}
    assert settings_.fixed_policy(0.3)["scoring"]["target_retention_ratio"] == 0.3
    with pytest.raises(KeyError):
        settings_.config(scoring={"no_such": 1})
    with pytest.raises(FileNotFoundError):
        settings_.config("no_such")


def test_run_modes(spark, sf_dir):
    grid = adapters.detection_frames(spark, sf_dir).where("video_id = 'v1'").cache()
    feats, motion = adapters.grid_features(spark, sf_dir), scoring.level_motion(grid)
    n = grid.count()
    fixed = sampler.run(grid, feats, motion, settings_.config())
    assert fixed.selection.count() == round(n * 0.2)
    kept = sampler.run(grid, feats, motion, settings_.config("adaptive_v4"))
    b = kept.bounds.first()
    assert b["soft_n"] <= kept.selection.count() <= b["n_max"]
    with pytest.raises(ValueError):
        sampler.run(grid, feats, motion, settings_.config(scoring={"algorithm": "magic"}))


def test_shuffled_rows_give_the_same(spark, sf_dir):
    x = adapters.gray_frames(spark, sf_dir)
    a, b = (scoring.pixel_motion(y).orderBy("video_id", "frame_idx").collect() for y in (x, x.orderBy(F.rand(1))))
    assert a == b


def test_empty_tables(spark):
    frames = spark.createDataFrame([], "video_id string, frame_idx int, score double")
    assert selection.top_ratio(frames, 0.2).count() == 0 and online_keep(frames).count() == 0
    total = spark.createDataFrame([("v", 3)], "video_id string, n long")
    assert report.manifest(frames, total, "none").first()["n_kept"] == 0


def test_delta_map_bounds(spark, sf_dir):
    x = adapters.features(spark, sf_dir).withColumn("past", history("feat", 5, frame_window()))
    got = x.select(context.delta_map(F.col("feat"), F.col("past")).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert got[0] >= -1e-6 and got[1] <= 2


def test_command_line(spark, sf_dir, tmp_path):
    from strandmill import cli

    adapters.label_frames(spark, sf_dir).where("video_id = 'v0'").write.parquet(str(tmp_path / "labels"))
    coded = cli.main(["compress", "--frames", str(tmp_path / "labels"), "--out", str(tmp_path / "o")])
    back = cli.main(["decompress", "--packets", f"{coded}/packets", "--out", str(tmp_path / "o")])
    a, b = (spark.read.parquet(p).orderBy("frame_idx").select("video_id", "frame_idx", "labels").collect() for p in (str(tmp_path / "labels"), f"{back}/labels"))
    assert a == b
    args = cli.parser().parse_args(["sample", "--frames", "f", "--features", "g", "--motion", "m", "--policy", "adaptive", "--min-retention", "0.2", "--preset", "light"])
    cfg = cli.settings(args)
    assert (cfg["adaptive"]["min_retention_ratio"], cfg["scoring"]["algorithm"], cfg["scoring"]["retention_mode"]) == (0.2, "motion_gated", "adaptive")
