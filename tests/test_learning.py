import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluation as E
from ledgerloom.operators import isolation
from ledgerloom.operators import learning as L

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.3, size=600) > 1.2).astype(int)
    rows = [(i, i, int(t), "kind" if t else "", *map(float, v)) for i, (t, v) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "row_id long, step long, y int, archetype string, a double, b double, c double").cache()


SPECS = L.registry(trees=10, rounds=5)
SPECS["reconstruction_error"].params["k"] = 2


@pytest.mark.parametrize("name", list(SPECS))
def test_scores_rise_with_suspicion(data, name):
    fitted = L.fit(SPECS[name], data, COLUMNS)
    scores = fitted.scores(data, keep=["row_id", "y"])
    assert scores.count() == 600 and scores.where("score IS NULL OR isnan(score)").count() == 0
    if name not in ("reconstruction_error", "isolation_forest"):
        assert E.metrics(scores).first()["roc_auc"] > 0.85


@pytest.mark.parametrize("name", ["logistic_regression", "gradient_boosting"])
def test_contributions_add_up_to_the_log_odds(data, name):
    fitted = L.fit(SPECS[name], data, COLUMNS)
    some = data.where("row_id < 40")
    p = {r["row_id"]: r["score"] for r in fitted.scores(some).collect()}
    for r in L.explain(fitted, some, top=2).collect():
        total = r["bias"] + sum(f["contribution"] for f in r["all_features"])
        assert total == pytest.approx(np.log(p[r["row_id"]] / (1 - p[r["row_id"]])), abs=1e-4)
        sizes = [abs(f["contribution"]) for f in r["all_features"]]
        assert sizes == sorted(sizes, reverse=True) and len(r["top_features"]) == 2


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    x[0] = (9.0, -9.0)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "row_id long, u double, v double")
    forest = isolation.fit(df, ["u", "v"], trees=40, per_tree=256)
    top = isolation.score(df, ["u", "v"], forest).orderBy(F.desc("isolation_raw")).first()
    assert top["row_id"] == 0 and len(forest) == 40
    again = isolation.score(df, ["u", "v"], isolation.fit(df.repartition(3), ["u", "v"], trees=40, per_tree=256))
    assert again.where("row_id = 0").first()["isolation_raw"] == pytest.approx(top["isolation_raw"])


def test_permutation_importance_ranks_the_signal_first(data):
    fitted = L.fit(SPECS["random_forest"], data, COLUMNS)
    out = L.permutation_importance(fitted, data, repeats=2).collect()
    assert out[0]["feature"] == "a" and len(out) == 3
    assert L.feature_importance(fitted).first()["feature"] == "a"


def test_canary_needs_equal_features(data):
    a, b = L.fit(SPECS["random_forest"], data, COLUMNS), L.fit(SPECS["random_forest"], data, ["a", "b"])
    with pytest.raises(ValueError):
        L.canary(a, b, data)
    assert L.canary(a, a, data).first()["delta_pp"] == 0.0


def test_adoption_gate(spark):
    trials = spark.createDataFrame([(-1, 0.50), (0, 0.505), (1, 0.52)], "trial int, pr_auc double")
    assert L.adoption(trials, promote=True).first()["adopted"] and L.adoption(trials).first()["adopted"] is False
    assert not L.adoption(trials, min_improvement=0.05, promote=True).first()["adopted"]


def test_linear_explanations_stay_in_the_jvm(data):
    why = L.explain(L.fit(SPECS["logistic_regression"], data, COLUMNS), data)
    assert "Python" not in why._jdf.queryExecution().toString() and "MapIn" not in why._jdf.queryExecution().toString()


def test_isolation_carries_columns_and_samples_alike(data):
    forest = isolation.fit(data, COLUMNS, trees=30, per_tree=64)
    out = isolation.score(data, COLUMNS, forest, keep=["y", "archetype"])
    assert out.columns == ["y", "archetype", "isolation_raw"] and out.count() == 600
    for per_tree in (8, 64, 2000):
        drawn = isolation._samples(data.select("row_id"), 30, per_tree, 1).count()
        assert abs(drawn - 30 * per_tree) < 0.2 * 30 * per_tree
