"""The registered model queries run the benchmark's sizes."""

from ledgerloom.operators import learning as L
from ledgerloom.plans import learning_queries
from ledgerloom.plans.registry import QUERIES


class Asked(Exception):
    pass


def asked(spark, sf, monkeypatch, query, operator):
    """The arguments with which a query calls an operator."""
    seen = {}

    def stop(train, *args, **options):
        seen.update(args=args, **options)
        raise Asked

    monkeypatch.setattr(L, operator, stop)
    try:
        QUERIES[query](spark, sf)
    except Asked:
        pass
    return seen


def test_models_are_whole():
    assert learning_queries.SPECS == L.registry()
    assert learning_queries.SPECS["random_forest"].params["numTrees"] == 250
    assert learning_queries.SPECS["gradient_boosting"].params["maxIter"] == 300


def test_all_models_are_cross_validated(spark, sf, monkeypatch):
    seen = asked(spark, sf, monkeypatch, "cross_validated_models", "cross_validate")
    assert seen["folds"] == 5 and seen["args"] == (L.registry(),)


def test_search_is_whole(spark, sf, monkeypatch):
    seen = asked(spark, sf, monkeypatch, "parameter_search", "search")
    base, trials = seen["args"]
    assert seen["folds"] == 5 and base == L.registry()["gradient_boosting"] and len(trials) == 30
    assert not any("maxIter" in t for t in trials)
