import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluation as E


def frame(spark, y, s):
    return spark.createDataFrame([(i, i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "row_id long, step long, y int, score double")


def test_perfect_and_inverted(spark):
    good = E.metrics(frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])).first()
    assert tuple(good) == (1.0, 1.0, 1.0, 1.0, 1.0)
    bad = E.metrics(frame(spark, [1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9])).first()
    assert bad["roc_auc"] == 0.0 and bad["recall"] == 0.0


def test_ties_count_half(spark):
    assert E.metrics(frame(spark, [0, 1], [0.5, 0.5])).first()["roc_auc"] == 0.5


def test_single_class_has_no_area(spark):
    assert E.metrics(frame(spark, [0, 0], [0.1, 0.9])).first()["roc_auc"] is None


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 120), rng.integers(0, 25, 120) / 25.0
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap, before = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        recall, precision = np.mean(pos >= t), np.mean(y[s >= t])
        ap, before = ap + (recall - before) * precision, recall
    got = E.metrics(frame(spark, y, s)).first()
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-4) and got["pr_auc"] == pytest.approx(ap, abs=1e-4)


def test_calibration_edges(spark):
    values = [0.1, 0.3, 0.6, 0.7, 0.8, 1.0]
    bins = E.calibration_curve(frame(spark, [0] * 6, values)).orderBy("mean_pred").collect()
    assert [r["bin"] for r in bins] == [1, 2, 5, 6, 8, 9]


def test_canary_boundary(spark):
    table = lambda rows: spark.createDataFrame(rows, "archetype string, recall double, support long")
    diff = E.canary_diff(table([("a", 1.0, 9), ("b", 0.9, 9), ("gone", 0.5, 3)]), table([("a", 0.95, 9), ("b", 0.8, 9), ("new", 0.5, 4)]), 0.05)
    out = {r["archetype"]: r for r in diff.collect()}
    assert not out["a"]["regressed"] and out["b"]["regressed"]
    assert out["gone"]["delta_pp"] is None and out["new"]["delta_pp"] is None and out["new"]["support"] == 4
    assert E.canary_verdict(diff).first()["verdict"] == "regressed"


def test_buckets_are_floor_edges(spark):
    out = E.temporal_stability(frame(spark, [0] * 13, [0.1] * 13), buckets=5).orderBy("bucket").collect()
    edges = np.linspace(0, 13, 6).astype(int)
    assert [(r["start_step"], r["end_step"]) for r in out] == [(a, b - 1) for a, b in zip(edges, edges[1:])]


def test_negatives_cap_is_exact_and_keeps_positives(spark):
    df = frame(spark, [1 if i % 20 == 0 else 0 for i in range(400)], [0.0] * 400)
    capped = E.negatives_cap(df, 150, buckets=16)
    counts = {r["y"]: r["n"] for r in capped.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 20, 0: 130}
    assert capped.select("row_id").distinct().count() == 150
    assert E.negatives_cap(df, 1000).count() == 400 and E.negatives_cap(df, 10).count() == 400


def test_folds(spark):
    out = E.time_series_folds(spark.range(20).withColumnRenamed("id", "row_id"), F.lit(20), 5).collect()
    assert [r["fold"] for r in out] == [-1] * 5 + [f for f in range(5) for _ in range(3)]


def test_explainable_model_wins_within_the_leader_deviation(spark):
    rows = [("forest", 0.85, 0.05, 0.8, False), ("boost", 0.83, 0.02, 0.8, True), ("linear", 0.5, 0.02, 0.5, True)]
    cv = spark.createDataFrame(rows, "model string, pr_auc_mean double, pr_auc_std double, holdout_pr_auc double, explainable boolean")
    assert E.select_model(cv).first()["selected"] == "boost"
    assert E.select_model(cv, prefer_explainable=False).first()["selected"] == "forest"
    assert E.select_model(cv, tolerance_std=0.1).first()["selected"] == "forest"
