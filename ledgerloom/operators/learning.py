"""Fraud models: training window, registry, scores, cross-validation, search, explanations.

Logistic regression and the random forest are MLlib's; the booster, the linear
classifier, the network and the isolation forest are trained by the sibling modules.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import boosting, gradient, isolation
from ledgerloom.operators.blocks import global_index
from ledgerloom.operators.features import FEATURES
from ledgerloom.session import pin


# ------------------------------------------------------------------ scaling
@dataclass
class Scaler:
    """Means and population deviations of the training window, one number each per column."""

    means: dict[str, float]
    deviations: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaler:
        row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
        return cls({c: row[f"m_{c}"] or 0.0 for c in columns}, {c: row[f"s_{c}"] or 1.0 for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(self.deviations[c]) for c, m in self.means.items()})


def with_class_weight(df: DataFrame, y: str = "y") -> DataFrame:
    """Balanced weights n / (2 * n_class)."""
    n, pos = df.agg(F.count("*").alias("n"), F.sum(y).alias("p")).first()
    pos = pos or 0
    weight = F.when(F.col(y) == 1, n / (2.0 * max(pos, 1))).otherwise(n / (2.0 * max(n - pos, 1)))
    return df.withColumn("weight", weight)


# ------------------------------------------------------------------ registry
@dataclass
class Spec:
    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    scaled: bool = False
    explainable: bool = False


def registry(seed: int = 42, trees: int = 250, rounds: int = 300) -> dict[str, Spec]:
    """The benchmark's six models. `trees` and `rounds` are the full sizes."""
    return {
        "logistic_regression": Spec("logistic", {"maxIter": 2000}, scaled=True, explainable=True),
        "random_forest": Spec("forest", {"numTrees": trees, "maxDepth": 8, "seed": seed}),
        "gradient_boosting": Spec("boosting", {"maxIter": rounds, "stepSize": 0.05, "maxLeaves": 31, "seed": seed}, explainable=True),
        "linear_svm": Spec("svm", {"maxIter": 2000, "seed": seed}, scaled=True),
        "isolation_forest": Spec("isolation", {"trees": trees, "seed": seed}),
        "reconstruction_error": Spec("reconstruction", {"k": 16, "seed": seed}, scaled=True),
    }


_CLASSIFIERS = {"logistic": LogisticRegression, "forest": RandomForestClassifier}


@dataclass
class Fitted:
    """A trained model with what is needed to score: higher always means more suspicious."""

    spec: Spec
    columns: list[str]
    model: Any
    scaler: Scaler | None = None

    def prepared(self, df: DataFrame) -> DataFrame:
        scaled = self.scaler.transform(df) if self.scaler else df
        return scaled if self.spec.kind not in _CLASSIFIERS else VectorAssembler(inputCols=self.columns, outputCol="features").transform(scaled)

    def scores(self, df: DataFrame, name: str = "score", keep: Sequence[str] = ("row_id",)) -> DataFrame:
        """Probability, isolation score or mean squared reconstruction error."""
        rows = self.prepared(df)
        kind = self.spec.kind
        if kind == "isolation":
            return isolation.score(rows, self.columns, self.model, name=name, keep=keep)
        if kind == "boosting":
            return boosting.score(rows, self.model, name, keep)
        if kind == "svm":
            return rows.select(*keep, self.model.probability().alias(name))
        if kind == "reconstruction":
            return rows.select(*keep, self.model.column(F.array(*self.columns)).alias(name))
        return self.model.transform(rows).select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias(name))


def fit(spec: Spec, train: DataFrame, columns: Sequence[str] = FEATURES) -> Fitted:
    """Train on (row_id, y, columns); classifiers get balanced class weights."""
    columns = list(columns)
    scaler = Scaler.fit(train, columns) if spec.scaled else None
    out = Fitted(spec, columns, None, scaler)
    if spec.kind == "isolation":
        out.model = isolation.fit(train, columns, **spec.params)
    elif spec.kind == "boosting":
        out.model = boosting.fit(train, columns, boosting.Params(**spec.params))
    elif spec.kind == "svm":
        out.model = gradient.fit_linear(out.prepared(train), columns, gradient.HuberParams(**spec.params))
    elif spec.kind == "reconstruction":
        out.model = gradient.fit_network(out.prepared(train), columns, gradient.NetworkParams(**spec.params))
    else:
        estimator = _CLASSIFIERS[spec.kind](featuresCol="features", labelCol="y", weightCol="weight", **spec.params)
        out.model = estimator.fit(out.prepared(with_class_weight(train)))
    return out


# ------------------------------------------------------------------ training window
def training_split(features: DataFrame, test_size: float = 0.25, max_train_rows: int | None = 600_000) -> tuple[DataFrame, DataFrame]:
    """Earlier rows train, later rows test. Positives all stay when negatives are thinned out."""
    split = E.temporal_split(features, test_size)
    train, test = split.where("is_train").drop("is_train"), split.where("NOT is_train").drop("is_train")
    if max_train_rows:
        if train.count() > max_train_rows:
            train = E.negatives_cap(train, max_train_rows)
    return train, test


def cross_validate(train: DataFrame, specs: dict[str, Spec], columns: Sequence[str] = FEATURES, folds: int = 5, parallel: int = 4) -> DataFrame:
    """Metrics per (model, fold) over expanding time-series folds; `train` is a training window in order of `row_id`.

    All boosters of all folds are one Spark stage over shared codes. Of the
    others ``parallel`` fits run at a time; their scores are stored at once.
    """
    names = [c for c in train.columns if c != "row_id"]
    train = pin(global_index(train, ["row_id"], "_at").select(F.col("_at").alias("row_id"), *names), "window")
    n = train.agg(F.count("*")).scalar()
    folded = pin(E.time_series_folds(train, n, folds), "folds")
    spans = folded.where("fold >= 0").groupBy("fold").agg(F.min("row_id").alias("first"), F.max("row_id").alias("last"))
    first = {r["fold"]: r["first"] for r in spans.collect()}
    boosters = {name: boosting.Params(**spec.params) for name, spec in specs.items() if spec.kind == "boosting"}
    scored = [boosting.fold_scores(train, columns, boosters, spans)] if boosters else []

    def one(fold: int, name: str, spec: Spec) -> DataFrame:
        rows = fit(spec, folded.where(F.col("row_id") < first[fold]), columns).scores(folded.where(F.col("fold") == fold), keep=["row_id", "y", "fold"])
        return pin(rows.withColumn("model", F.lit(name)), "fold-scores")

    fits = [(fold, name, spec) for fold in first for name, spec in specs.items() if name not in boosters]
    with ThreadPoolExecutor(parallel) as pool:
        scored += pool.map(lambda f: one(*f), fits)
    return E.metrics(reduce(DataFrame.unionByName, scored), by=["model", "fold"])


def search(train: DataFrame, base: Spec, trials: Sequence[dict[str, Any]], columns: Sequence[str] = FEATURES, folds: int = 3) -> DataFrame:
    """Mean cross-validated PR-AUC of the base parameters (trial -1) and of every trial."""
    specs = {"-1": base, **{str(i): Spec(base.kind, {**base.params, **t}, base.scaled, base.explainable) for i, t in enumerate(trials)}}
    per_fold = cross_validate(train, specs, columns, folds)
    return per_fold.groupBy(F.col("model").cast("int").alias("trial")).agg(F.coalesce(F.avg("pr_auc"), F.lit(-1.0)).alias("pr_auc"))


def adoption(trials: DataFrame, min_improvement: float = 0.01, promote: bool = False) -> DataFrame:
    """Best trial against the baseline; adopted only when promoted, real, and clearly better."""
    return trials.agg(
        F.max_by("trial", F.struct("pr_auc", -F.col("trial"))).alias("best_trial"),
        F.max("pr_auc").alias("best"),
        F.max(F.when(F.col("trial") == -1, F.col("pr_auc"))).alias("baseline"),
    ).select(
        "best_trial", "best", "baseline", (F.col("best") - F.col("baseline")).alias("improvement"),
        (F.lit(promote) & (F.col("best") > 0) & (F.col("best") - F.col("baseline") >= min_improvement)).alias("adopted"),
    )


def random_trials(n: int, seed: int = 42) -> list[dict[str, Any]]:
    """Seeded draws from the booster's search space: leaves, step, rows per leaf, both penalties, column share."""
    rng = np.random.default_rng(seed)
    log = lambda low, high: float(np.exp(rng.uniform(np.log(low), np.log(high))))
    return [
        {
            "maxLeaves": int(log(16, 257)),
            "stepSize": log(0.01, 0.3),
            "minInstancesPerNode": int(rng.integers(5, 101)),
            "l1": log(1e-8, 10.0),
            "l2": log(1e-8, 10.0),
            "columnShare": float(rng.uniform(0.5, 1.0)),
        }
        for _ in range(n)
    ]


# ------------------------------------------------------------------ importance
def feature_importance(fitted: Fitted, top: int = 15) -> DataFrame:
    """Native importances of a tree model or absolute coefficients of a linear one."""
    from pyspark.sql import SparkSession

    model = fitted.model
    if fitted.spec.kind == "boosting":
        values = model.importances()
    elif fitted.spec.kind == "svm":
        values = np.abs(model.weights)
    else:
        values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else np.abs(model.coefficients.toArray())
    rows = [(c, float(v)) for c, v in zip(fitted.columns, values)]
    frame = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature").limit(top)


def permutation_importance(fitted: Fitted, holdout: DataFrame, repeats: int = 5, top: int = 15) -> DataFrame:
    """Mean loss of PR-AUC when one feature is shuffled among all holdout rows.

    The shuffle is by hash order, so a rerun shuffles the same way: rows are
    numbered by id and, per repeat, by hash, and the row of the same number
    lends its features. All features of a repeat are scored as one frame.
    """
    rows = pin(global_index(holdout.select("row_id", "y", *fitted.columns), ["row_id"], "_at"), "permutation")
    base = E.metrics(fitted.scores(rows, keep=["y"])).select("pr_auc").scalar()
    shuffled = None
    for repeat in range(repeats):
        places = global_index(rows.select("row_id"), [F.xxhash64(F.lit(repeat), F.col("row_id")), F.col("row_id")], "_at")
        donor = places.join(rows.select("row_id", F.struct(*fitted.columns).alias("donor")), "row_id").select("_at", "donor")
        pairs = rows.join(donor, "_at").withColumn("feature", F.explode(F.array(*[F.lit(c) for c in fitted.columns])))
        mixed = pairs.withColumns({c: F.when(F.col("feature") == c, F.col(f"donor.{c}")).otherwise(F.col(c)) for c in fitted.columns})
        part = E.metrics(fitted.scores(mixed.drop("donor", "_at"), keep=["y", "feature"]), by=["feature"])
        shuffled = part if shuffled is None else shuffled.unionByName(part)
    return (
        shuffled.groupBy("feature")
        .agg(F.avg(base - F.col("pr_auc")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )


# ------------------------------------------------------------------ explanations
def explain(fitted: Fitted, df: DataFrame, top: int = 8) -> DataFrame:
    """Contributions per row: they and the bias add up to the model's log-odds.

    Linear models: coefficient times distance from the training mean, exact.
    Boosted trees: exact Shapley values with training rows as cover weights. Rows
    are scored first and explained after, so `df` is usually a short list.
    """
    kind = fitted.spec.kind
    if kind == "logistic":
        out = _linear_parts(fitted, df)
    elif kind == "boosting":
        out = _tree_parts(fitted, df)
    else:
        raise ValueError(f"no additive explanation for {kind}")
    return out.withColumn("base_probability", C.rnd(C.logistic(F.col("bias")), 4)).withColumn(
        "top_features", F.slice("all_features", 1, top)
    )


def _linear_parts(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Coefficient times scaled feature, whose training mean is zero; plain expressions."""
    weights, bias = fitted.model.coefficients.toArray(), float(fitted.model.intercept)
    scaled = fitted.scaler.transform(df) if fitted.scaler else df
    parts = [F.struct(F.lit(c).alias("feature"), (F.col(c) * F.lit(float(w))).alias("contribution")) for c, w in zip(fitted.columns, weights)]

    def larger_first(a, b):
        x, y = F.abs(a["contribution"]), F.abs(b["contribution"])
        return F.when(x > y, -1).when(x < y, 1).otherwise(0)

    rows = scaled.select("row_id", F.array(*parts).alias("parts"))
    total = F.aggregate("parts", F.lit(bias), lambda t, p: t + p["contribution"])
    return rows.select("row_id", F.lit(bias).alias("bias"), total.alias("log_odds"), F.array_sort("parts", larger_first).alias("all_features"))


def _tree_parts(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Contributions of boosted trees as number arrays; the features are named afterwards."""
    found, bias = boosting.contributions(df, fitted.model)
    names = F.array(*[F.lit(c) for c in fitted.columns])
    named = F.zip_with(
        "places", "sizes", lambda i, v: F.struct(F.element_at(names, (i + 1).cast("int")).alias("feature"), v.alias("contribution"))
    )
    return found.select("row_id", F.lit(bias).alias("bias"), "log_odds", named.alias("all_features"))


def canary(old: Fitted, new: Fitted, holdout: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Recall per archetype of two models on the same holdout. Different feature lists are an error."""
    if old.columns != new.columns:
        raise ValueError("the models were trained on different features")
    keep = ["row_id", "y", "archetype"]
    table = lambda m: E.archetype_recall(m.scores(holdout, keep=keep))
    return E.canary_diff(table(old), table(new), tolerance)


