"""Explainable detectors and the rule score they add up to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions import columns as C
from ledgerloom.operators.asof import asof_forward
from ledgerloom.operators.rollups import category_day_stats, daily_category_totals
from ledgerloom.session import pin

# rows of (id, two flags): some 20 MB at most
MARKS_BROADCAST = 1_000_000
SHOWN = ["row_id", "step", "amount", "nameOrig", "nameDest", "category", "merchant"]


def duplicate_charges(df: DataFrame, window_days: float = K.DUPLICATE_WINDOW_DAYS, by_account: bool = False) -> DataFrame:
    """Later charge of the same merchant and amount within the window, focal rows only.

    The order inside a group matters only down to the hour: every row but the
    first of its hour repeats at distance zero, and the first repeats the last
    earlier hour. So the ordered pass runs over distinct hours of a group, and
    the rows come back through an equi join on (group, hour).
    """
    rows = (
        df.where(F.col("is_focal_user") & F.col("type").isin(K.DUPLICATE_TYPES))
        .withColumn("_amt", F.bround("amount", 2))
    )
    keys = ["merchant", "_amt", *(["nameOrig"] if by_account else [])]
    order = Window.partitionBy(*keys).orderBy("step")
    hours = (
        rows.groupBy(*keys, "step")
        .agg(F.min("row_id").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_near", F.coalesce(F.col("step") - F.lag("step").over(order) <= F.lit(window_days * 24), F.lit(False)))
        .where(F.col("_near") | (F.col("_n") > 1))
    )
    return (
        rows.join(hours.select(*keys, "step", "_first", "_near"), [*keys, "step"])
        .where(F.col("_near") | (F.col("row_id") != F.col("_first")))
        .select("row_id", "step", "amount", "merchant", "category", F.lit("duplicate_charge").alias("reason"))
    )


def drain_pairs(
    df: DataFrame,
    window_hours: float = K.DRAIN_WINDOW_HOURS,
    min_amount: float = K.DRAIN_MIN_AMOUNT,
    drain_ratio: float = K.DRAIN_RATIO,
) -> DataFrame:
    """Transfers that drain an account, each with the nearest cash-out of its destination.

    The amount test looks at that nearest cash-out only.
    """
    transfers = df.where(
        (F.col("type") == "TRANSFER")
        & (F.col("amount") >= min_amount)
        & (F.col("oldbalanceOrg") > 0)
        & (F.col("newbalanceOrig") <= drain_ratio * F.col("oldbalanceOrg"))
    ).select("row_id", "step", "amount", "nameOrig", F.col("nameDest").alias("_key"))
    cashouts = df.where(F.col("type") == "CASH_OUT").select(
        "row_id", "step", "amount", F.col("nameOrig").alias("_key")
    )
    paired = asof_forward(transfers, cashouts, "_key", "step", ["amount"], int(window_hours))
    return paired.where(F.col("match.amount") >= K.DRAIN_MATCH * F.col("amount")).select(
        F.col("row_id").alias("transfer_id"),
        F.col("step").alias("transfer_step"),
        F.col("amount").alias("transfer_amount"),
        "nameOrig",
        F.col("_key").alias("destination"),
        F.col("match.row_id").alias("cashout_id"),
        F.col("match.step").alias("cashout_step"),
        F.col("match.amount").alias("cashout_amount"),
    )


def _both_sides(pairs: DataFrame) -> DataFrame:
    """One row per side of each pair: its row and the values it is recognised by."""
    sides = F.array(
        F.struct(F.col("transfer_id").alias("row_id"), F.col("transfer_step").alias("step"), F.col("nameOrig").alias("nameOrig"), F.bround("transfer_amount", 2).alias("_amt")),
        F.struct(F.col("cashout_id").alias("row_id"), F.col("cashout_step").alias("step"), F.col("destination").alias("nameOrig"), F.bround("cashout_amount", 2).alias("_amt")),
    )
    return pairs.select(F.inline(sides))


def balance_drains(df: DataFrame, match_on: str = "row_id", **params) -> DataFrame:
    """Rows on either side of a drain pair.

    `match_on="values"` flags every row that shares (step, origin, amount) with
    a side of a pair, `"row_id"` just the paired rows.
    """
    sides = _both_sides(drain_pairs(df, **params))
    if match_on == "values":
        keys = ["step", "nameOrig", "_amt"]
        rows = df.withColumn("_amt", F.bround("amount", 2)).join(sides.select(*keys).distinct(), keys, "left_semi")
    else:
        rows = df.join(sides.select("row_id").distinct(), "row_id", "left_semi")
    return rows.select(*SHOWN, F.lit("balance_drain").alias("reason"))


def spike_days(df: DataFrame, z_threshold: float = K.SPIKE_Z, trailing: bool = False) -> DataFrame:
    """Days on which a category's total lies `z_threshold` deviations above its mean.

    The baseline is the full history of the category, or with `trailing` only
    the days before. At most one row per calendar day and spending category.
    """
    daily = daily_category_totals(df)
    if trailing:
        earlier = Window.partitionBy("category").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
        scored = daily.withColumn("mean", F.avg("total").over(earlier)).withColumn("std", F.stddev_samp("total").over(earlier))
    else:
        scored = daily.join(F.broadcast(category_day_stats(daily)), "category")
    z = F.try_divide(F.col("total") - F.col("mean"), F.col("std"))
    return scored.where(z >= z_threshold).select("date", "category", "total", z.alias("z"))


def spend_spikes(df: DataFrame, z_threshold: float = K.SPIKE_Z, trailing: bool = False) -> DataFrame:
    """Transactions on spike days. The days are bounded by the calendar: broadcast."""
    days = spike_days(df, z_threshold, trailing).select("date", "category")
    return df.join(F.broadcast(days), ["date", "category"]).select(
        "row_id", "step", "date", "amount", "category", "merchant", F.lit("spend_spike").alias("reason")
    )


def _settings(cfg: dict | None) -> dict[str, float]:
    cfg = cfg or {}
    return {
        "window_hours": float(cfg.get("balance_drain_window_hours", K.DRAIN_WINDOW_HOURS)),
        "min_amount": float(cfg.get("balance_drain_min_amount", K.DRAIN_MIN_AMOUNT)),
        "window_days": float(cfg.get("duplicate_charge_window_days", K.DUPLICATE_WINDOW_DAYS)),
        "z": float(cfg.get("spike_z_threshold", K.SPIKE_Z)),
    }


def _score_and_reason(df: DataFrame, drain: Column, duplicate: Column, spike: Column) -> DataFrame:
    """Score is the strongest rule; the reason is that of the last rule to fire."""
    return df.withColumn(
        "rule_score",
        F.when(drain, K.SCORE_DRAIN).when(duplicate, K.SCORE_DUPLICATE).when(spike, K.SCORE_SPIKE).otherwise(0.0),
    ).withColumn(
        "rule_reason",
        F.when(spike, K.REASON_SPIKE).when(duplicate, K.REASON_DUPLICATE).when(drain, K.REASON_DRAIN).otherwise(""),
    )


def rule_risk_flags(df: DataFrame, cfg: dict | None = None, match_on: str = "row_id") -> DataFrame:
    """Every ledger row with `rule_score` and `rule_reason`.

    `match_on="row_id"` scores the detected rows; `"step"` scores every row in
    the same hour as a detected one, across accounts.
    """
    p = _settings(cfg)
    if match_on == "step":
        drains = balance_drains(df, "values", window_hours=p["window_hours"], min_amount=p["min_amount"])
        marks = (
            drains.select("step", F.lit("d").alias("k"))
            .unionByName(duplicate_charges(df, p["window_days"]).select("step", F.lit("u").alias("k")))
            .unionByName(spend_spikes(df, p["z"]).select("step", F.lit("s").alias("k")))
            .groupBy("step")
            .agg(*[F.max(F.col("k") == k).alias(f"_{k}") for k in "dus"])
        )
        # one row per hour of the calendar at most: broadcast
        joined = df.join(F.broadcast(marks), "step", "left")
        out = _score_and_reason(joined, F.col("_d"), F.col("_u"), F.col("_s"))
        return out.select(*df.columns, "rule_score", "rule_reason")
    sides = _both_sides(drain_pairs(df, p["window_hours"], p["min_amount"]))
    marks = (
        sides.select("row_id", F.lit("d").alias("k"))
        .unionByName(duplicate_charges(df, p["window_days"]).select("row_id", F.lit("u").alias("k")))
        .groupBy("row_id")
        .agg(*[F.max(F.col("k") == k).alias(f"_{k}") for k in "du"])
    )
    # few rows are flagged: once stored and counted they can be broadcast, else both sides shuffle on the unique id
    marks = pin(marks, "marks")
    if marks.count() <= MARKS_BROADCAST:
        marks = F.broadcast(marks)
    days = spike_days(df, p["z"]).select("date", "category", F.lit(True).alias("_s"))
    joined = df.join(F.broadcast(days), ["date", "category"], "left").join(marks, "row_id", "left")
    out = _score_and_reason(joined, F.col("_d"), F.col("_u"), F.col("_s"))
    return out.select(*df.columns, "rule_score", "rule_reason")


def validate_blend(weights: dict[str, float], threshold: float = K.FRAUD_THRESHOLD) -> None:
    """Weights lie in 0..1 and add up to one; the threshold lies in 0..1."""
    for name, value in weights.items():
        if not 0.0 <= value <= 1.0:
            raise ValueError(f"weight {name} is outside 0..1: {value}")
    if abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError(f"weights add up to {sum(weights.values())}, not 1")
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold is outside 0..1: {threshold}")


def blend(scored: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Risk score and reason from `rule_score` and, where present, raw model scores.

    Without `model_raw` and `isolation_raw` the risk is the rule score itself.
    With them, `scored` must be a stored frame: its isolation range is read
    first, and recomputing the models for that would score twice.
    """
    if not {"model_raw", "isolation_raw"} <= set(scored.columns):
        out = scored.withColumn("model_score", F.lit(0.0)).withColumn("isolation_score", F.lit(0.0))
        risk = F.col("rule_score")
    else:
        w = weights or K.BLEND
        validate_blend(w)
        low, high = (scored.agg(f("isolation_raw")).scalar() for f in (F.min, F.max))
        iso = C.min_max(F.col("isolation_raw"), low, high)
        out = scored.withColumn("_iso", iso)
        risk = w["rules"] * F.col("rule_score") + w["supervised"] * F.col("model_raw") + w["isolation_forest"] * F.col("_iso")
        out = out.withColumn("model_score", C.rnd("model_raw", 3)).withColumn("isolation_score", C.rnd("_iso", 3))
    return out.withColumn("risk_score", C.rnd(risk, 3)).withColumn("reason", reason()).drop("_iso", "model_raw", "isolation_raw")


def reason() -> Column:
    """Non-empty parts joined by "; "; `concat_ws` skips the nulls."""
    return F.concat_ws(
        "; ",
        F.nullif(F.col("rule_reason"), F.lit("")),
        F.when(F.col("model_score") >= 0.6, F.concat(F.lit("model fraud probability "), F.format_number("model_score", 2))),
        F.when(F.col("isolation_score") >= 0.85, F.lit(K.REASON_ISOLATION)),
    )


def flagged(
    scored: DataFrame,
    threshold: float = K.FRAUD_THRESHOLD,
    focal_only: bool = False,
    user: str | None = None,
    account_type: str | None = None,
) -> DataFrame:
    """Rows at or above the threshold of the rounded score, narrowed before any limit."""
    out = scored.where(F.col("risk_score") >= threshold)
    if focal_only:
        out = out.where(F.col("nameOrig") == user) if user else out.where("is_focal_user")
    if account_type and "account_type" in scored.columns:
        out = out.where(F.col("account_type") == account_type)
    return out


def top_risk(scored: DataFrame, limit: int = 15, columns: Sequence[str] | None = None, **where) -> DataFrame:
    """Highest risk first, ties in row order: a bounded top-k per partition, then merged."""
    rows = flagged(scored, **where)
    if columns:
        rows = rows.select(*columns)
    return rows.orderBy(F.desc("risk_score"), "row_id").limit(limit)


def risk_summary(scored: DataFrame, threshold: float = K.FRAUD_THRESHOLD) -> DataFrame:
    counts = scored.agg(F.count_if(F.col("risk_score") >= threshold).alias("flagged"), F.count("*").alias("total"))
    return counts.select("flagged", "total", C.rnd(F.try_divide(100.0 * F.col("flagged"), F.col("total")), 1).alias("pct"))
