import pytest
from ledgers import ledger, random_rows
from pyspark.sql import functions as F

from ledgerloom.operators.features import FEATURES, build_features
from ledgerloom.sources import conform


@pytest.fixture(scope="module")
def rows(spark):
    return ledger(spark, random_rows(3, 200)).cache()


def test_contract(spark, rows):
    out = build_features(rows)
    assert out.columns == ["row_id", *FEATURES] and len(FEATURES) == 32
    assert {t for c, t in out.dtypes if c != "row_id"} == {"double"}
    bad = out.where(" OR ".join(f"{c} IS NULL OR isnan({c})" for c in FEATURES))
    assert bad.count() == 0 and out.count() == 200


def test_negative_balances(spark):
    df = ledger(spark, [dict(step=1, oldbalanceOrg=-350.0, oldbalanceDest=-2210.23)])
    out = build_features(df).first()
    assert out["log_oldbalance_orig"] == 0.0 and out["log_oldbalance_dest"] == 0.0 and out["amount_ratio_dest"] == 0.0


def test_backward_only(spark, rows):
    prefix = build_features(rows.where("step <= 90"))
    full = build_features(rows).join(prefix.select("row_id"), "row_id", "left_semi")
    assert prefix.exceptAll(full.select(prefix.columns)).count() == 0 and prefix.count() > 20


def test_legacy_ledger_degrades_to_neutral(spark, rows):
    out = build_features(conform.conform(rows.drop(*conform.DEFAULTS)))
    assert out.agg(F.max("region_distance_miles"), F.max("is_out_of_home_region"), F.min("account_checking")).first()[:] == (0.0, 0.0, 1.0)


def test_missing_required_column_is_an_error(spark, rows):
    with pytest.raises(ValueError, match="amount"):
        conform.conform(rows.drop("amount"))


def test_shuffles_once_per_key_family(spark, sf):
    from ledgerloom.sources.ledger import ledger as stored

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = build_features(stored(spark, sf))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 3
