"""Order statistics, picture operators, key playback and the raw sink against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandmill.operators import codec, imaging, reconstruct, scoring
from strandmill.operators.order_statistics import quantiles, top_rows
from strandmill.plans import compressor
from strandmill.session import durable
from strandmill.sources import hooks, scan


def clips():
    rng = np.random.default_rng(6)
    yield "one", np.array([0.5])
    yield "two", np.array([1.0, 0.0])
    yield "equal", np.full(700, 0.2)
    yield "ties", rng.integers(0, 4, 5000) / 4
    yield "floor", np.where(rng.random(4000) < 0.9, 0.2, rng.random(4000))
    yield "wide", rng.lognormal(0, 3, 9000)
    yield "sorted", np.arange(3000) / 7
    yield "negative", rng.normal(size=333)


@pytest.fixture(scope="module")
def scores(spark):
    rows = pd.concat([pd.DataFrame({"video_id": name, "frame_idx": np.arange(len(v)), "score": v}) for name, v in clips()])
    return spark.createDataFrame(rows).repartition(5).cache()


def test_quantiles(scores):
    asked = {"low": 0.01, "mid": 0.5, "p": 0.8, "high": 0.999, "top": 1.0, "bottom": 0.0}
    got = {r["video_id"]: r for r in quantiles(scores.select("video_id", F.col("score").alias("value")), asked).collect()}
    for name, v in clips():
        assert got[name]["n"] == len(v)
        for q, share in asked.items():
            assert got[name][q] == pytest.approx(np.quantile(v, share), rel=1e-14, abs=1e-12), (name, q)


def test_quantiles_pass_over_nulls(spark):
    rows = spark.createDataFrame([("v", 1.0), ("v", None), ("v", 3.0), ("w", None)], "video_id string, value double")
    assert [(r["video_id"], r["n"], r["m"]) for r in quantiles(rows, {"m": 0.5}).collect()] == [("v", 2, 2.0)]
    assert quantiles(rows.where("false"), {"m": 0.5}).count() == 0


def test_top_rows(spark, scores):
    for share in (0.0, 0.1, 0.5, 1.0):
        counts = scores.groupBy("video_id").agg(F.floor(F.count("*") * share).alias("k"))
        got = {}
        for r in top_rows(scores, counts).collect():
            got.setdefault(r["video_id"], set()).add(r["frame_idx"])
        for name, v in clips():
            order = np.lexsort((np.arange(len(v)), -v))
            assert got.get(name, set()) == set(order[: int(len(v) * share)].tolist()), (name, share)


def test_chunked_motion_equals_whole(spark):
    rng = np.random.default_rng(0)
    frames = spark.createDataFrame([("v", i, rng.integers(0, 256, 16).tolist()) for i in range(60)], "video_id string, frame_idx int, px array<int>")
    assert scoring.pixel_motion(frames, chunk=7).orderBy("frame_idx").collect() == scoring.pixel_motion(frames, chunk=None).orderBy("frame_idx").collect()
    labels = frames.withColumnRenamed("px", "labels")
    assert reconstruct.temporal_stack(labels, 3, chunk=7).orderBy("frame_idx").collect() == reconstruct.temporal_stack(labels, 3, chunk=None).orderBy("frame_idx").collect()


def test_decode_frames_that_have_no_changes(spark):
    triples = spark.createDataFrame([("v", 1, 0, 1, 5), ("v", 3, 0, 1, 0), ("v", 3, 1, 0, 2), ("v", 4, 0, 0, 9)], "video_id string, frame_idx int, y int, x int, label int")
    frames = spark.createDataFrame([("v", i) for i in (0, 1, 2, 3, 4, 5)] + [("w", 0)], "video_id string, frame_idx int")
    got = {(r[0], r[1]): r[2] for r in codec.delta_decode(triples, frames, 2, 2, 4).collect()}
    zero = [0, 0, 0, 0]
    assert got == {("v", 0): zero, ("v", 1): [0, 5, 0, 0], ("v", 2): [0, 5, 0, 0], ("v", 3): [0, 0, 2, 0], ("v", 4): [9, 0, 0, 0], ("v", 5): [9, 0, 0, 0], ("w", 0): zero}


def pictures(spark, n=12, h=9, w=10, c=3, seed=1):
    rng = np.random.default_rng(seed)
    data = [rng.integers(0, 256, (h, w, c), dtype=np.uint8) for _ in range(n)]
    rows = [(f"v{i % 2}", i // 2, h, w, c, bytearray(d.tobytes())) for i, d in enumerate(data)]
    return spark.createDataFrame(rows, "video_id string, frame_idx int, height int, width int, n_channels int, data binary"), data


def test_windowed_ssim(spark):
    a, x = pictures(spark)
    b, y = pictures(spark, seed=2)
    got = {(r[0], r[1]): r[2] for r in imaging.windowed_ssim(a, b).collect()}
    c1, c2 = 6.5025, 58.5225
    for i, (p, q) in enumerate(zip(x, y)):
        each = []
        for k in range(3):
            for r in range(3):
                for s in range(4):
                    u, v = p[r : r + 7, s : s + 7, k].astype(float).ravel(), q[r : r + 7, s : s + 7, k].astype(float).ravel()
                    cov = np.cov(u, v)
                    each.append((2 * u.mean() * v.mean() + c1) * (2 * cov[0, 1] + c2) / ((u.mean() ** 2 + v.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2)))
        assert got[f"v{i % 2}", i // 2] == pytest.approx(np.mean(each), abs=1e-9)
    assert all(r[2] == pytest.approx(1) for r in imaging.windowed_ssim(a, a).collect())


def test_picture_queries_equal_their_functions(spark):
    frames, data = pictures(spark)
    soft, guides = pictures(spark, seed=3)
    key = lambda i: (f"v{i % 2}", i // 2)
    bytes_of = lambda df: {(r["video_id"], r["frame_idx"]): bytes(r["data"]) for r in df.collect()}
    out = bytes_of(imaging.refined(frames, soft, sharpen=0.35))
    assert out == {key(i): imaging.light_sharpen(imaging.post_refine(d, g), g, 0.35).tobytes() for i, (d, g) in enumerate(zip(data, guides))}
    assert bytes_of(imaging.rgb_frames(frames)) == {key(i): d[:, :, ::-1].tobytes() for i, d in enumerate(data)}
    back = imaging.from_pixels(imaging.to_pixels(frames), 9, 10, 3)
    assert bytes_of(back) == bytes_of(frames)


def test_dilated(spark):
    maps = np.random.default_rng(4).integers(0, 6, (5, 4, 6))
    df = spark.createDataFrame([("v", i, m.ravel().tolist()) for i, m in enumerate(maps)], "video_id string, frame_idx int, labels array<int>")
    got = {r[1]: r[2] for r in imaging.dilated(df, 4, 6).collect()}
    for i, m in enumerate(maps):
        want = [[m[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].max() for x in range(6)] for y in range(4)]
        assert got[i] == np.array(want).ravel().tolist()


def test_keys_and_playback(spark):
    frames, data = pictures(spark)
    labels = frames.select("video_id", "frame_idx", F.array_repeat(F.col("frame_idx") % 3, 64).alias("labels"))
    cfg = {"soft_edge": {"rgb_keyframe_interval": 3, "keyframe_interval": 30, "rgb_only": True}}
    coded = durable(compressor.compress(labels, cfg, raw=frames))
    got = {(r["video_id"], r["frame_idx"]): bytes(r["data"]) for r in compressor.decode_keys(coded).collect()}
    assert got == {(f"v{i % 2}", i // 2): d.tobytes() for i, d in enumerate(data) if i // 2 % 3 == 0}
    played = {(r["video_id"], r["frame_idx"]): r["px"] for r in compressor.playback(coded, frames, 3).collect()}
    mixed = np.floor(np.round(data[0] * (2 / 3) + data[6] * (1 / 3), 6)).astype(int).ravel().tolist()
    assert len(played) == 12 and played["v0", 3] == data[6].astype(int).ravel().tolist() and played["v0", 1] == mixed
    with pytest.raises(ValueError, match="neither"):
        compressor.compress(labels, cfg)
    with pytest.raises(NotImplementedError):
        hooks.lookup("encode_picture", "jpeg")


def test_block_flow_finds_a_shift():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 256, (16, 16, 1), dtype=np.uint8)
    b = np.roll(a, (1, -2), axis=(0, 1))
    flow = imaging.block_flow(a, b)
    assert (flow[4:12, 4:12] == (-2, 1)).all() and (imaging.block_flow(a, a) == 0).all()


def test_flow_interpolation(spark):
    frames, data = pictures(spark)
    got = {(r["video_id"], r["frame_idx"]): bytes(r["data"]) for r in imaging.flow_interpolation(frames, 3).collect()}
    assert len(got) == 12 and got["v0", 0] == data[0].tobytes() and got["v1", 3] == data[7].tobytes()
    want = imaging.flow_interpolate(data[0], data[6], imaging.block_flow(data[0], data[6]), 1 / 3, 0.15)
    assert got["v0", 1] == want.tobytes()


def test_hybrid_blend(spark):
    px = spark.createDataFrame([("v", i, [10 * i, 255 - i]) for i in range(5)] + [("w", 1, [1, 2])], "video_id string, frame_idx int, px array<int>")
    got = {(r[0], r[1]): r[2] for r in reconstruct.hybrid_blend(px, px.where("frame_idx % 2 = 0"), 2, 0.4).collect()}
    assert got == {("v", 0): [0, 255], ("v", 1): [6, 254], ("v", 2): [20, 253], ("v", 3): [26, 252], ("v", 4): [40, 251], ("w", 1): [1, 2]}


def test_raw_sink(spark, tmp_path):
    frames, data = pictures(spark)
    scan.write_raw(frames, str(tmp_path / "out"))
    got = {(r["video_id"], r["frame_idx"], r["src_idx"]): bytes(r["data"]) for r in spark.read.format("raw_frames").option("stride", 2).load(str(tmp_path / "out")).collect()}
    assert got == {(f"v{i % 2}", i // 4, i // 2): d.tobytes() for i, d in enumerate(data) if i // 2 % 2 == 0}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["v0.json", "v0.raw", "v1.json", "v1.raw"]
    with pytest.raises(Exception, match="holds raw frames already"):
        scan.write_raw(frames, str(tmp_path / "out"))


def test_scan_limits_each_video(spark):
    src = spark.createDataFrame([(v, i) for v in "ab" for i in range(20)], "video_id string, src_idx long")
    got = scan.scan(src, 3, 4).orderBy("video_id", "frame_idx").collect()
    assert [(r["video_id"], r["frame_idx"], r["src_idx"]) for r in got] == [(v, k, 3 * k) for v in "ab" for k in range(4)]


def test_materialised(spark):
    held = scan.materialised(spark.range(10))
    assert held.is_cached and held.count() == 10
    held.unpersist()


def test_durable_forgets_sizes(spark):
    df = spark.range(100).selectExpr("id", "id % 7 as k")
    for _ in range(14):
        df = durable(df.join(df.groupBy("k").count(), "k").select("id", "k"))
    assert df.count() == 100


def test_telea():
    flat = np.full((12, 14, 3), 77, np.uint8)
    hole = np.zeros((12, 14), np.uint8)
    hole[4:8, 5:10] = 1
    broken = flat.copy()
    broken[hole == 1] = 0
    assert (imaging.telea(broken, hole) == 77).all()
    ramp = np.repeat((np.arange(14) * 15)[None, :, None], 12, axis=0).repeat(3, axis=2).astype(np.uint8)
    broken = ramp.copy()
    broken[hole == 1] = 255
    out = imaging.telea(broken, hole)
    assert (out[hole == 0] == ramp[hole == 0]).all() and np.abs(out.astype(int) - ramp).max() <= 12
    assert (imaging.telea(flat, hole * 0) == flat).all() and (imaging.telea(flat, hole * 0 + 1) == flat).all()
    soft = np.zeros((20, 20, 3), np.uint8)
    soft[9, 9] = 200
    assert (imaging.baseline_reconstruct(soft) == 0).all() and (imaging.baseline_reconstruct(soft * 0) == 0).all()


def test_progress_and_steps():
    from strandmill.plans import config
    from strandmill.plans.progress import Progress, steps

    said = []
    plan = steps(config.config("quality"), debug=True, input_clip=True)
    assert plan == ["Materialise the frames", "Score and select", "Write the input clip", "Write the sampled frames", "Write the overlay", "Write manifest and report"]
    assert steps(config.config("light"))[0].startswith("Gate by motion")
    p = Progress(plan[:2], said.append)
    for _ in range(3):
        p.begin()
        assert p.done("fine") >= 0
    assert said[0].startswith("[1/2] Materialise") and said[4].startswith("[3/3] Step 3") and said[1].endswith("fine")


def test_renumbered(spark):
    from strandmill.plans.combo import renumbered

    rows = [("v", i, [i % 5]) for i in (0, 3, 4, 4096, 9000, 9001, 20000)] + [("w", 7, [1])]
    got = renumbered(spark.createDataFrame(rows, "video_id string, frame_idx int, labels array<int>")).orderBy("video_id", "frame_idx").collect()
    assert [(r["video_id"], r["frame_idx"], r["src_idx"]) for r in got] == [("v", k, i) for k, i in enumerate((0, 3, 4, 4096, 9000, 9001, 20000))] + [("w", 0, 7)]


def test_combo_command(spark, sf_dir, tmp_path):
    from strandmill import cli
    from strandmill.sources import adapters

    grid = adapters.detection_frames(spark, sf_dir).where("video_id in ('v1', 'v2') and frame_idx < 100")
    grid.write.parquet(str(tmp_path / "f"))
    adapters.grid_features(spark, sf_dir).join(grid.select("video_id", "frame_idx"), ["video_id", "frame_idx"]).write.parquet(str(tmp_path / "g"))
    scoring.level_motion(grid).write.parquet(str(tmp_path / "m"))
    labels = adapters.label_frames(spark, sf_dir).where("video_id in ('v1', 'v2')")
    labels.write.parquet(str(tmp_path / "l"))
    where = cli.main(["combo", *[x for n, d in (("frames", "f"), ("features", "g"), ("motion", "m"), ("labels", "l")) for x in (f"--{n}", str(tmp_path / d))], "--out", str(tmp_path), "--frame-bytes", "64", "--policy", "adaptive"])
    kept = spark.read.parquet(f"{where}/selection")
    back = spark.read.parquet(f"{where}/labels")
    want = {(r["video_id"], r["frame_idx"]): r["labels"] for r in labels.join(kept.select("video_id", "frame_idx"), ["video_id", "frame_idx"]).collect()}
    assert {(r["video_id"], r["src_idx"]): r["labels"] for r in back.collect()} == want and 20 < len(want) < 200
    sizes = spark.read.json(f"{where}/sizes").collect()
    assert sum(r["n_kept"] for r in sizes) == len(want) and all(r["n_total"] == 100 for r in sizes)


def test_semantic_ablation_loop(spark, sf_dir):
    from strandmill.operators import baselines, context
    from strandmill.sources import adapters

    features = adapters.features(spark, sf_dir).where("video_id in ('v0', 'v3')")
    got = {(r["video_id"], r["frame_idx"]) for r in baselines.semantic_ablation(features, 0.2).collect()}
    want = set()
    for video in ("v0", "v3"):
        x = np.array([r["feat"] for r in features.where(f"video_id = '{video}'").orderBy("frame_idx").collect()])
        score = []
        for t in range(len(x)):
            past = x[max(0, t - 15) : t]
            reps, centers = context.diverse_context(past, 3)
            delta = 1 - max(float(past[i] @ x[t]) for i in reps) if t else 1.0
            fresh = min(1.0, min(float(np.linalg.norm(c - x[t])) for c in centers) / 1.414) if t else 1.0
            score.append(round(delta * fresh, 9))
        order = sorted(range(len(x)), key=lambda i: (-score[i], i))
        want |= {(video, i) for i in order[: round(len(x) * 0.2)]}
    assert got == want


def test_fill_background_loop():
    rng = np.random.default_rng(9)
    soft = np.where(rng.random((9, 11, 1)) < 0.15, rng.integers(30, 256, (9, 11, 3)), 0).astype(np.uint8)
    level = soft.astype(float)
    known = imaging.gray(soft[:, :, ::-1]) > 0
    while not known.all():
        ring = []
        for y in range(9):
            for x in range(11):
                near = [level[r, c] for r in range(max(0, y - 1), min(9, y + 2)) for c in range(max(0, x - 1), min(11, x + 2)) if known[r, c]]
                if not known[y, x] and near:
                    ring.append((y, x, np.mean(near, axis=0)))
        for y, x, v in ring:
            level[y, x], known[y, x] = v, True
    assert (imaging.fill_background(soft) == np.clip(np.rint(level), 0, 255)).all()


def test_palette_fit_finds_clear_clusters(spark):
    rng = np.random.default_rng(10)
    centers = np.array([[10, 10, 10], [200, 30, 40], [60, 220, 90]])
    px = (centers[rng.integers(0, 3, 600)] + rng.integers(-4, 5, (600, 3))).astype(float).tolist()
    got = codec.fit_palette(spark.createDataFrame(px, "r double, g double, b double"), clusters=3)
    assert np.abs(np.array(sorted(got)) - np.array(sorted(centers.tolist()))).max() < 2
    assert codec.fit_palette(spark.createDataFrame([], "r double, g double, b double"), clusters=2) == [(0.0, 0.0, 0.0)] * 2
