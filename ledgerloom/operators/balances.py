"""Running and clamped balances per account, and days since the last payday."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.operators.blocks import BLOCK_ROWS, HOT_ROWS, HotKeys, global_index, prior_totals


def account_events(df: DataFrame) -> DataFrame:
    """Each transaction as seen by its origin and, for transfers to a known account, by its destination.

    Inside one hour source events come before destination events.
    """
    sign = F.when(F.col("type").isin(K.CREDIT_TYPES), 1.0).otherwise(-1.0)
    source = df.select(
        F.col("nameOrig").alias("account"), "step", F.lit(0).alias("side"), "row_id", (sign * F.col("amount")).alias("delta")
    )
    known = df.select(F.col("nameOrig").alias("account")).distinct()
    target = df.where(F.col("type") == "TRANSFER").select(
        F.col("nameDest").alias("account"), "step", F.lit(1).alias("side"), "row_id", F.col("amount").alias("delta")
    )
    return source.unionByName(target.join(known, "account", "left_semi"))


def running_balances(
    df: DataFrame, opening: Column | float = 0.0, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Plain and clamped balance after every event of every account.

    The clamped balance never falls below zero: it is the plain one minus the
    lowest (negative) prefix so far. Credit accounts, which hold debt, are
    clamped at zero from above instead.

    Blocks of hot accounts follow the order of the window itself: with a hot
    account all events are numbered in (step, side, row_id) order, which also
    stores them, so that they are derived once.
    """
    start = F.lit(opening) if isinstance(opening, float) else opening
    events = account_events(df)
    moment = ["step", "side", "row_id"]
    keys = HotKeys(events, ["account"], "_at", hot_rows, block_rows)
    if keys.found:
        events = global_index(events, moment, "_at")
    hot = keys.only(events)
    order = Window.partitionBy("account", "_blk").orderBy(*moment)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    carried = prior_totals(hot, ["account"], {"_sum": ("sum", F.col("delta"))})

    def balanced(rows: DataFrame) -> DataFrame:
        summed = keys.carry(rows.withColumn("_in", F.sum("delta").over(upto)), carried, {"_sum": "double"})
        return summed.withColumn("balance", start + F.coalesce("_sum", F.lit(0.0)) + F.col("_in"))

    plain = balanced(keys.blocks(events))
    bounds = prior_totals(balanced(hot) if hot is not None else None, ["account"], {"_low": ("min", F.col("balance")), "_high": ("max", F.col("balance"))})
    low = F.least(F.min("balance").over(upto), F.col("_low"), start, F.lit(0.0))
    high = F.greatest(F.max("balance").over(upto), F.col("_high"), start, F.lit(0.0))
    clamped = F.when(F.col("account").endswith("_Cred"), F.col("balance") - high).otherwise(F.col("balance") - low)
    return keys.carry(plain, bounds, {"_low": "double", "_high": "double"}).select(
        "account", "step", "side", "row_id", "delta", "balance", clamped.alias("clamped")
    )


def days_since_payday(df: DataFrame, cap: int = 6) -> DataFrame:
    """Per account and active day: days since the last salary, at most `cap`.

    Works on one row per account and day, so it is bounded by the calendar.
    """
    days = df.groupBy("nameOrig", F.to_date("date").alias("day")).agg(F.max(F.col("type") == "SALARY").alias("paid"))
    upto = Window.partitionBy("nameOrig").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("paid"), F.col("day")), ignorenulls=True).over(upto)
    since = F.least(F.coalesce(F.datediff("day", last), F.lit(cap)), F.lit(cap))
    return days.select("nameOrig", F.col("day").cast("string").alias("day"), since.alias("days_since_payday"))
