"""The published run: its score levels fix every aggregate of adaptive selection."""

import math

import pytest
from pyspark.sql import functions as F

from strandmill.operators import scoring, selection, thresholds
from strandmill.plans.config import config

LEVELS = {0.2875: 16, 0.325: 96, 0.3625: 144, 0.4: 40, 0.4375: 72, 0.475: 79, 0.5125: 40, 0.55: 12}


@pytest.fixture(scope="module")
def scores(spark):
    values = [3.2837102671977276] + [v for v, n in LEVELS.items() for _ in range(n)]
    return spark.createDataFrame([("v", i, s) for i, s in enumerate(values)], "video_id string, frame_idx int, score double").cache()


def test_stats(scores):
    r = thresholds.score_stats(scores).first()
    assert (r["min"], r["median"], r["max"]) == (0.2875, 0.3625, 3.2837102671977276)
    assert r["p90"] == pytest.approx(0.5125) and (r["frac_below_1e4"], r["frac_above_001"]) == (0.0, 1.0)


def test_first_tau_leaves_ties_out(scores):
    tau = thresholds.adaptive_tau(scores, config("adaptive_v4")).first()["tau"]
    assert tau == pytest.approx(0.4) and scores.where(F.col("score") > tau).count() in (203, 204)
    assert scores.where(F.col("score") > 0.4).count() == 204 - 0 * tau


def test_bounds_and_selection(spark, scores):
    cfg = config("adaptive_v4")
    rich = spark.createDataFrame([("v", 500, 0.002, 0.9)], "video_id string, n long, busy double, information double")
    bounds = thresholds.retention_bounds(rich, cfg)
    assert tuple(bounds.first())[2:] == (255, 384, 425)
    kept = selection.adaptive_select(scores, bounds, cfg)
    assert kept.count() == 384
    assert kept.first()["tau"] == pytest.approx(0.3625)
    assert kept.where("score > 0.3625").count() == 244


def test_frame_zero(spark):
    cfg = config("adaptive_v4")
    row = spark.createDataFrame([(1.0, 1.0, 6)], "sem double, motion double, n int")
    sem = F.lit(1.0 / math.log(8))
    got = row.select(scoring.blended(sem, F.col("motion"), F.col("n"), cfg).alias("s")).first()["s"]
    assert got == pytest.approx((1 / math.log(8) + 0.35) * 1.9 * 2.08)
    assert got == pytest.approx(3.2837102671977276)


def test_all_equal_scores_fill_by_place(spark):
    same = spark.createDataFrame([("v", i, 0.5) for i in range(50)], "video_id string, frame_idx int, score double")
    bounds = spark.createDataFrame([("v", 50, 5, 10, 20)], "video_id string, n long, n_min long, soft_n long, n_max long")
    kept = selection.adaptive_select(same, bounds, config("adaptive_v4"))
    assert sorted(r["frame_idx"] for r in kept.collect()) == list(range(10))


def test_too_many_above_are_thinned(spark):
    cfg = config("adaptive_v4")
    s = spark.createDataFrame([("v", i, 0.1 + i / 100) for i in range(40)], "video_id string, frame_idx int, score double")
    bounds = spark.createDataFrame([("v", 40, 2, 3, 5)], "video_id string, n long, n_min long, soft_n long, n_max long")
    kept = sorted(r["frame_idx"] for r in selection.adaptive_select(s, bounds, cfg).collect())
    assert kept == selection.diverse_picks(__import__("numpy").arange(40) / 100, 5, None)
    assert min(b - a for a, b in zip(kept, kept[1:])) >= 4
