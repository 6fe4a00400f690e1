"""The 32 backward-looking features of a transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions import columns as C
from ledgerloom.operators.blocks import BLOCK_ROWS, HOT_ROWS, HotKeys, prior_rows, prior_totals
from ledgerloom.session import pin, unpin

FEATURES = [
    "amount",
    "log_amount",
    "amount_ratio_orig",
    "amount_ratio_dest",
    "balance_after_ratio",
    "log_oldbalance_orig",
    "log_oldbalance_dest",
    "is_focal",
    "count_prior_orig",
    "sum_amount_prev7_orig",
    "steps_since_prev_orig",
    "count_prior_dest",
    "sum_amount_prev7_dest",
    "hour_of_day",
    "amount_vs_category_mean",
    "region_distance_miles",
    "is_out_of_home_region",
    "is_new_merchant",
    "is_new_payee",
    *[f"account_{t}" for t in K.ACCOUNT_TYPES],
    "is_weekend",
    *[f"type_{t}" for t in K.TYPES],
]

_INPUTS = [
    "row_id", "step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest", "oldbalanceDest",
    "merchant", "category", "datetime", "is_focal_user", "account_type", "transaction_region", "home_region",
]
ORDER = ["step", "row_id"]


def _one_hot(column: str, values: list[str], prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{v}": F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in values}


def value_features() -> dict[str, Column]:
    """Features that need the row alone."""
    amount, old_o, old_d = F.col("amount"), F.col("oldbalanceOrg"), F.col("oldbalanceDest")
    return {
        "log_amount": F.log1p(amount),
        "amount_ratio_orig": F.try_divide(amount, old_o + 1.0),
        "amount_ratio_dest": F.when(old_d > 0, F.try_divide(amount, old_d + 1.0)).otherwise(F.lit(0.0)),
        "balance_after_ratio": F.try_divide(F.col("newbalanceOrig"), old_o + 1.0),
        "log_oldbalance_orig": F.log1p(F.greatest(old_o, F.lit(0.0))),
        "log_oldbalance_dest": F.log1p(F.greatest(old_d, F.lit(0.0))),
        "is_focal": F.col("is_focal_user").cast("double"),
        "hour_of_day": F.pmod(F.col("step"), F.lit(24)).cast("double"),
        **_one_hot("account_type", K.ACCOUNT_TYPES, "account"),
        **_one_hot("type", K.TYPES, "type"),
    }


def _place_and_day(df: DataFrame) -> DataFrame:
    """Region and calendar features; numbers replace the long strings before any shuffle."""
    away = F.col("transaction_region") != F.col("home_region")
    weekend = F.weekday(F.to_date(F.substring("datetime", 1, 10))) >= 5
    return (
        C.with_region_distance(df)
        .withColumn("is_out_of_home_region", F.when(away, 1.0).otherwise(0.0))
        .withColumn("is_weekend", F.when(weekend, 1.0).otherwise(0.0))
        .drop("transaction_region", "home_region", "datetime")
    )


_TAIL = "array<struct<step: bigint, row_id: bigint, amount: double>>"


def _velocity(df: DataFrame, keys: HotKeys, hot: DataFrame | None, side: str) -> DataFrame:
    """Prior count, sum of the previous seven amounts, and hours since the previous row."""
    order = Window.partitionBy(*keys.keys, "_blk").orderBy(*ORDER)
    counts = prior_totals(hot, keys.keys, {"_prior_n": ("sum", F.lit(1).cast("long"))})
    tails = prior_rows(hot, keys.keys, ORDER, ["amount"], 7, "_tail7")
    out = (
        df.withColumn("_pos", F.row_number().over(order) - 1)
        .withColumn("_sum7", F.sum("amount").over(order.rowsBetween(-7, -1)))
        .withColumn("_prev", F.lag("step").over(order))
    )
    out = keys.carry(keys.carry(out, counts, {"_prior_n": "long"}), tails, {"_tail7": _TAIL})
    tail = F.col("_tail7")
    size = F.coalesce(F.size(tail), F.lit(0))
    # the block holds only `_pos` of the seven previous rows: take the rest from the tail
    rest = F.greatest(F.lit(0), F.least(size, 7 - F.col("_pos"))).cast("int")
    carried = F.when(
        rest > 0, F.aggregate(F.slice(tail, size - rest + 1, rest), F.lit(0.0), lambda s, r: s + r["amount"])
    ).otherwise(F.lit(0.0))
    last = F.when(size > 0, F.try_element_at(tail, F.lit(-1))["step"])
    out = out.withColumn(f"count_prior_{side}", (F.col("_pos") + F.coalesce("_prior_n", F.lit(0))).cast("double")).withColumn(
        f"sum_amount_prev7_{side}", F.coalesce("_sum7", F.lit(0.0)) + carried
    )
    if side == "orig":
        out = out.withColumn(
            "steps_since_prev_orig", F.coalesce(F.col("step") - F.coalesce("_prev", last), F.lit(999)).cast("double")
        )
    return out.drop("_pos", "_sum7", "_prev", "_prior_n", "_tail7")


def _first_seen(df: DataFrame, key: str, hot: DataFrame | None, other: str, name: str) -> DataFrame:
    """1.0 on the first row of each (key, other) pair.

    Inside a block the first row is a candidate; for a hot key it counts only
    in the pair's earliest block.
    """
    order = Window.partitionBy(key, "_blk", other).orderBy(*ORDER)
    out, counts = df.withColumn("_rn", F.row_number().over(order)), F.col("_rn") == 1
    if hot is not None:
        earliest = hot.groupBy(key, other).agg(F.min("_blk").alias("_blk")).withColumn("_earliest", F.lit(True))
        out = out.join(earliest, [key, "_blk", other], "left")
        counts = counts & ((F.col("_blk") < 0) | F.col("_earliest"))
    return out.withColumn(name, F.when(counts, 1.0).otherwise(0.0)).drop("_rn", "_earliest")


def _category_mean(df: DataFrame, keys: HotKeys, hot: DataFrame | None) -> DataFrame:
    """Amount against the mean of earlier rows of the category; a first row is neutral."""
    earlier = Window.partitionBy("category", "_blk").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    carried = prior_totals(
        hot, ["category"], {"_prior_n": ("sum", F.lit(1).cast("long")), "_prior_s": ("sum", F.col("amount"))}
    )
    n = F.col("_n") + F.coalesce("_prior_n", F.lit(0))
    s = F.coalesce("_s", F.lit(0.0)) + F.coalesce("_prior_s", F.lit(0.0))
    mean = F.coalesce(F.try_divide(s, n), F.col("amount"))
    out = df.withColumn("_n", F.count("amount").over(earlier)).withColumn("_s", F.sum("amount").over(earlier))
    return (
        keys.carry(out, carried, {"_prior_n": "long", "_prior_s": "double"})
        .withColumn("amount_vs_category_mean", F.try_divide(F.col("amount"), mean + 1.0))
        .drop("_n", "_s", "_prior_n", "_prior_s")
    )


def build_features(df: DataFrame, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS, staged: bool = False) -> DataFrame:
    """`row_id` and the 32 features, all doubles, none null."""
    return history_features(df, hot_rows, block_rows, staged).withColumns(value_features()).select("row_id", *FEATURES)


def history_features(df: DataFrame, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS, staged: bool = False) -> DataFrame:
    """The features that need other rows, with the columns the others follow from (`value_features`).

    Windows that share an origin account follow each other, so the rows
    are shuffled once per key family: origin, destination, category. With `staged` they are stored
    after the first two, so the files of one shuffle are gone before the next; `unpin` deletes the last. Keys that
    hold more than `hot_rows` rows are processed in blocks of consecutive rows.
    """
    base = df.select(*_INPUTS)
    count = base.count()
    keys = {k: HotKeys(base, [k], "row_id", hot_rows, block_rows, count) for k in ("nameOrig", "nameDest", "category")}
    hot = {
        k: keys[k].only(base.select(*dict.fromkeys(["row_id", "step", "amount", k, *extra])))
        for k, extra in {"nameOrig": ["merchant", "nameDest"], "nameDest": [], "category": []}.items()
    }
    out = keys["nameOrig"].blocks(_place_and_day(base))
    out = _velocity(out, keys["nameOrig"], hot["nameOrig"], "orig")
    out = _first_seen(out, "nameOrig", hot["nameOrig"], "merchant", "is_new_merchant")
    out = _first_seen(out, "nameOrig", hot["nameOrig"], "nameDest", "is_new_payee").drop("_blk", "nameOrig", "merchant")
    origin = pin(out, "origin-features") if staged else out
    out = keys["nameDest"].blocks(origin)
    out = _velocity(out, keys["nameDest"], hot["nameDest"], "dest").drop("_blk", "nameDest")
    both = pin(out, "account-features") if staged else out
    out = keys["category"].blocks(both)
    out = _category_mean(out, keys["category"], hot["category"]).drop("_blk", "category")
    if staged:
        unpin(origin)
        out._pinned = both._pinned
    return out
