"""Data-quality checks: each returns what it found, never a bare pass or fail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions import columns as C
from ledgerloom.operators.blocks import BLOCK_ROWS, HOT_ROWS, HotKeys, prior_rows

CENT = 0.02


def arithmetic_violations(df: DataFrame, tolerance: float = CENT) -> DataFrame:
    sign = F.when(F.col("type").isin(K.CREDIT_TYPES), 1.0).otherwise(-1.0)
    gap = F.col("newbalanceOrig") - (F.col("oldbalanceOrg") + sign * F.col("amount"))
    return df.where(F.abs(gap) > tolerance).select("row_id", "nameOrig", "type", gap.alias("gap"))


def chain_breaks(df: DataFrame, tolerance: float = CENT, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows whose opening balance is not the previous row's closing balance."""
    rows = df.select("row_id", "step", "nameOrig", "oldbalanceOrg", "newbalanceOrig")
    keys = HotKeys(rows, ["nameOrig"], "row_id", hot_rows, block_rows)
    order = Window.partitionBy("nameOrig", "_blk").orderBy("step", "row_id")
    carried = prior_rows(keys.only(rows), ["nameOrig"], ["step", "row_id"], ["newbalanceOrig"], 1, "_tail")
    before = F.coalesce("_lag", F.try_element_at("_tail", F.lit(-1))["newbalanceOrig"])
    chained = keys.blocks(rows).withColumn("_lag", F.lag("newbalanceOrig").over(order))
    tail = {"_tail": "array<struct<step: bigint, row_id: bigint, newbalanceOrig: double>>"}
    return (
        keys.carry(chained, carried, tail)
        .withColumn("previous", before)
        .where(F.abs(F.col("oldbalanceOrg") - F.col("previous")) > tolerance)
        .select("row_id", "nameOrig", "oldbalanceOrg", "previous")
    )


def negative_balances(df: DataFrame, tolerance: float = CENT) -> DataFrame:
    return df.where((F.col("newbalanceOrig") < -tolerance) & (F.col("account_type") != "credit")).select("row_id", "nameOrig", "newbalanceOrig")


def fraud_rate(df: DataFrame, low: float = 0.0005, high: float = 0.05) -> DataFrame:
    rate = F.avg(F.col("isFraud").cast("double"))
    return df.agg(C.rnd(rate, 6).alias("fraud_rate"), rate.between(low, high).alias("in_band"))


def missing_archetypes(df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Archetypes that no labelled row carries."""
    names = df.sparkSession.createDataFrame([(a,) for a in (wanted or K.FRAUD_ARCHETYPES)], "archetype string")
    seen = df.where((F.col("isFraud") == 1) | (F.col("is_anomaly") == 1)).select(F.col("fraud_archetype").alias("archetype")).distinct()
    return names.join(seen, "archetype", "left_anti")


def labelled_hard_negatives(df: DataFrame) -> DataFrame:
    rows = df.where(F.col("fraud_archetype").isin(K.HARD_NEGATIVES))
    return rows.groupBy("fraud_archetype").agg(
        F.count("*").alias("n"), F.count_if((F.col("isFraud") != 0) | (F.col("is_anomaly") != 0)).alias("labelled")
    )


def holiday_lift(df: DataFrame, category: str = "shopping") -> DataFrame:
    """Transactions per calendar day inside and outside the holiday window.

    Days without any transaction count too: the calendar is unfolded between
    the first and the last date.
    """
    span = df.agg(F.min(F.to_date("date")).alias("a"), F.max(F.to_date("date")).alias("b"))
    calendar = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    holiday = C.is_holiday(F.month("day"), F.dayofmonth("day")).alias("is_holiday")
    days = calendar.groupBy(holiday).agg(F.count("*").alias("days"))
    rows = df.where(F.col("is_focal_user") & (F.col("category") == category)).select(F.to_date("date").alias("day"))
    counts = rows.groupBy(holiday).agg(F.count("*").alias("transactions"))
    return days.join(counts, "is_holiday", "left").select(
        "is_holiday", "days", F.coalesce("transactions", F.lit(0)).alias("transactions"),
        C.rnd(F.coalesce("transactions", F.lit(0)) / F.col("days"), 6).alias("per_day"),
    )


def group_mismatches(df: DataFrame) -> DataFrame:
    wrong = F.col("category_group") != C.category_group(F.col("category"))
    return df.groupBy("category").agg(F.count_if(wrong).alias("mismatches"), F.count("*").alias("n"))


def label_lag(df: DataFrame) -> DataFrame:
    lag = F.col("label_reported_at_step") - F.col("step")
    return df.where(F.col("isFraud") == 1).agg(
        F.count_if(lag < 0).alias("negative"), F.count_if(lag > 0).alias("lagged"), F.max(lag).alias("max_lag")
    )


def pay_drift(df: DataFrame, first: int, last: int) -> DataFrame:
    """Ratio of mean salary between two years for personas paid in both."""
    salary = df.where(F.col("type") == "SALARY").groupBy("persona_id").agg(
        F.avg(F.when(F.col("simulation_year") == first, F.col("amount"))).alias("a"),
        F.avg(F.when(F.col("simulation_year") == last, F.col("amount"))).alias("b"),
    )
    return salary.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("persona_id", C.rnd(F.col("b") / F.col("a"), 6).alias("ratio"))


def account_growth(df: DataFrame, suffix: str = "_Sav") -> DataFrame:
    """Closing minus opening balance of each account with the suffix."""
    at = F.struct("step", "row_id")
    return (
        df.where(F.col("nameOrig").endswith(suffix))
        .groupBy("nameOrig")
        .agg((F.max_by("newbalanceOrig", at) - F.min_by("oldbalanceOrg", at)).alias("growth"))
    )


def schema_report(df: DataFrame) -> DataFrame:
    """Labels outside 0/1, and fraud without an archetype."""
    return df.agg(
        *[F.count_if(~F.col(c).isin(0, 1)).alias(f"{c}_not_binary") for c in ("isFraud", "isFlaggedFraud", "is_anomaly")],
        F.count_if((F.col("isFraud") == 1) & (F.coalesce("fraud_archetype", F.lit("")) == "")).alias("fraud_without_archetype"),
        F.count_if(F.col("amount") <= 0).alias("non_positive_amounts"),
    )


def account_structure(df: DataFrame) -> DataFrame:
    """Rows per channel, and those whose account name lacks the channel's suffix."""
    wrong = (
        F.when(F.col("account_type") == "credit", ~F.col("nameOrig").endswith("_Cred"))
        .when(F.col("account_type") == "savings", ~F.col("nameOrig").endswith("_Sav"))
        .otherwise(F.col("nameOrig").endswith("_Cred") | F.col("nameOrig").endswith("_Sav"))
    )
    return df.groupBy("account_type").agg(F.count("*").alias("n"), F.count_if(wrong).alias("misnamed"))


def merchant_concentration(df: DataFrame, top: int = 10) -> DataFrame:
    """Share of the rows held by the `top` busiest merchants."""
    counts = df.groupBy("merchant").agg(F.count("*").alias("n"))
    busiest = counts.orderBy(F.desc("n"), "merchant").limit(top).agg(F.sum("n").alias("top_rows"))
    total = counts.agg(F.sum("n")).scalar()
    return busiest.select("top_rows", total.alias("n_rows"), C.rnd(F.col("top_rows") / total, 6).alias("share"))


def region_signal(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("transaction_region") != F.col("home_region")).alias("away"),
        F.count_if(F.col("merchant_region").isNull()).alias("null_merchant_region"),
        F.count_if(F.col("home_region").isNull()).alias("null_home_region"),
    )


def fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Order-free digests of the whole content (or of each group): sums of row hashes, so repeated rows count.

    ``digest`` adds 60 bits of the MD5 of each row written as text, floating
    numbers with six digits, and can be recomputed anywhere. ``exact`` adds
    64-bit hashes of the binary values and tells any two numbers apart.
    """
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    number = lambda f: f.dataType.typeName() in ("double", "float")
    text = lambda f: (F.col(f.name).cast("decimal(38,6)") if number(f) else F.col(f.name)).cast("string")
    line = F.concat(*[F.concat(F.coalesce(text(f), F.lit("\\N")), F.lit("\x1f")) for f in fields])
    part = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("decimal(20,0)")
    exact = F.xxhash64(*[f.name for f in fields], F.lit(len(fields)))
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(part), F.lit(0)).cast("decimal(38,0)").cast("string").alias("digest"),
        F.coalesce(F.sum(exact.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias("exact"),
        F.count("*").alias("n"),
    )
