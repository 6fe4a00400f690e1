"""Model training, scoring, explanation and comparison.

All models are registered at the benchmark's sizes (250 trees, 300 rounds), the
search at its 30 trials, 5 folds and 300 rounds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import learning as L
from ledgerloom.operators import rules
from ledgerloom.operators.features import FEATURES
from ledgerloom.plans.registry import query
from ledgerloom.plans.rule_queries import FEATURES_SQL
from ledgerloom.plans.sqlkit import over_ledger, rnd
from ledgerloom.session import pin
from ledgerloom.sources.feature_table import stored_features
from ledgerloom.sources.ledger import ledger

SPECS = L.registry()
FOLDS, TRIALS = 5, 30
_FITTED: dict = {}


def split(spark, sf, labelled=True):
    """The bound on training rows is for models that use labels; the others see all earlier rows."""
    return L.training_split(stored_features(spark, sf), 0.25, 600_000 if labelled else None)


def model(spark, sf, name):
    """Each model is trained once per application and table."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _FITTED:
        labelled = SPECS[name].kind not in ("isolation", "reconstruction")
        _FITTED[key] = L.fit(SPECS[name], split(spark, sf, labelled)[0])
    return _FITTED[key]


def _holdout_metrics(spark, sf, name):
    scores = model(spark, sf, name).scores(split(spark, sf)[1], keep=["row_id", "y"])
    return E.metrics(scores).withColumn("model", F.lit(name))


@query(
    "scaled_training_window",
    over_ledger(
        "SELECT row_id, " + ", ".join(f"{rnd(f'(f.{c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END', 5)} AS {c}" for c in FEATURES)
        + " FROM features f, (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES)
        + " FROM features WHERE row_id < (SELECT floor(count(*) * 0.75::DOUBLE) FROM ledger)) WHERE row_id >= (SELECT floor(count(*) * 0.75::DOUBLE) FROM ledger)",
        FEATURES_SQL,
    ),
)
def _(spark, sf):
    train, test = L.training_split(stored_features(spark, sf), 0.25, None)
    return L.Scaler.fit(train, FEATURES).transform(test).select("row_id", *[C.rnd(c, 5).alias(c) for c in FEATURES])


def _register(name):
    @query(f"model_{name}")
    def _(spark, sf):
        return _holdout_metrics(spark, sf, name)


for _name in SPECS:
    _register(_name)


_RAW: dict = {}


def raw_scores(spark, sf):
    """Rule, model and isolation score of every row, stored once per application; both models score in one pass."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _RAW:
        return _RAW[key]
    features = stored_features(spark, sf)
    strange = model(spark, sf, "isolation_forest").scores(features, "isolation_raw", keep=["row_id", *FEATURES])
    both = model(spark, sf, "gradient_boosting").scores(strange, "model_raw", keep=["row_id", "isolation_raw"])
    flags = rules.rule_risk_flags(ledger(spark, sf)).select("row_id", "date", "merchant", "amount", "category", "rule_score", "rule_reason")
    _RAW[key] = pin(flags.join(both, "row_id"), "scores")
    return _RAW[key]


@query("blended_risk")
def _(spark, sf):
    return rules.blend(raw_scores(spark, sf))


@query("risk_explanations")
def _(spark, sf):
    """The riskiest rows with their contributions; rows without one keep a null."""
    fitted = model(spark, sf, "gradient_boosting")
    features = stored_features(spark, sf)
    top = pin(fitted.scores(features).orderBy(F.desc("score"), "row_id").limit(15), "top")
    chosen = features.join(F.broadcast(top.select("row_id")), "row_id", "left_semi")
    why = L.explain(fitted, chosen).select("row_id", "bias", "base_probability", "log_odds", "top_features")
    return top.join(why, "row_id", "left")


@query("linear_explanations")
def _(spark, sf):
    fitted = model(spark, sf, "logistic_regression")
    features = stored_features(spark, sf)
    return L.explain(fitted, features).select("row_id", "bias", "log_odds", F.get("top_features", 0)["feature"].alias("strongest"))


@query("feature_importance")
def _(spark, sf):
    return L.feature_importance(model(spark, sf, "gradient_boosting"))


@query("permutation_importance")
def _(spark, sf):
    return L.permutation_importance(model(spark, sf, "random_forest"), split(spark, sf)[1])


@query("canary_run")
def _(spark, sf):
    return L.canary(model(spark, sf, "random_forest"), model(spark, sf, "gradient_boosting"), split(spark, sf)[1])


@query("cross_validated_models")
def _(spark, sf):
    train = split(spark, sf)[0]
    return E.fold_summary(L.cross_validate(train, SPECS, folds=FOLDS), ["model"])


@query("parameter_search")
def _(spark, sf):
    train = split(spark, sf)[0]
    trials = pin(L.search(train, SPECS["gradient_boosting"], L.random_trials(TRIALS), folds=FOLDS), "trials")
    return trials.withColumns({c: L.adoption(trials, promote=True).select(c).scalar() for c in ("best_trial", "adopted")})
