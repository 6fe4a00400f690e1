"""Detectors for the published fraud signatures, and the patterns that excuse.

All work per account. What happened first is a plain grouped minimum, which
combines before the shuffle; what lies close in time is looked up in buckets of
the pattern's own length, so no account is ever gathered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.blocks import BLOCK_ROWS, HOT_ROWS, HotKeys, lookback_buckets, prior_rows
from ledgerloom.operators.rules import drain_pairs


def first_rows(df: DataFrame, other: str) -> DataFrame:
    """The first transaction of every (account, `other`) pair."""
    first = F.min(F.struct("step", "row_id", "type", "amount", "home_region"))
    return df.groupBy("nameOrig", other).agg(first.alias("f")).select("nameOrig", other, "f.*")


def card_testing(df: DataFrame, small: float = 7.5, large: float = 140.0, charges: int = 3, within: int = 2) -> DataFrame:
    """Several small charges at new merchants in one hour, then a large one soon after."""
    bursts = (
        first_rows(df, "merchant")
        .where((F.col("type") == "SHOP") & (F.col("amount") < small))
        .groupBy("nameOrig", "step")
        .agg(F.count("*").alias("small_charges"))
        .where(F.col("small_charges") >= charges)
    )
    later = bursts.select(
        "nameOrig",
        F.struct(F.col("step").alias("burst_step"), "small_charges").alias("b"),
        F.explode(F.array(*[F.col("step") + i for i in range(1, within + 1)])).alias("step"),
    ).groupBy("nameOrig", "step").agg(F.max("b").alias("b"))
    big = df.where((F.col("type") == "SHOP") & (F.col("amount") >= large)).select("row_id", "nameOrig", "step", "amount")
    return big.join(later, ["nameOrig", "step"]).select("row_id", "nameOrig", "step", "amount", "b.burst_step", "b.small_charges")


def slow_drain(df: DataFrame, low: float = 40.0, high: float = 160.0, transfers: int = 5, days: int = 22) -> DataFrame:
    """Many modest transfers to a payee within days of its first appearance."""
    modest = (F.col("type") == "TRANSFER") & F.col("amount").between(low, high)
    hourly = df.groupBy("nameOrig", "nameDest", "step").agg(
        F.count_if(modest).alias("n"), F.sum(F.when(modest, F.col("amount")).otherwise(0.0)).alias("total")
    )
    first = hourly.groupBy("nameOrig", "nameDest").agg(F.min("step").alias("first_step"))
    return (
        hourly.where(F.col("n") > 0)
        .join(first, ["nameOrig", "nameDest"])
        .where(F.col("step") <= F.col("first_step") + days * 24)
        .groupBy("nameOrig", "nameDest", "first_step")
        .agg(F.sum("n").alias("transfers"), F.sum("total").alias("total"))
        .where(F.col("transfers") >= transfers)
    )


def _new_regions(df: DataFrame) -> DataFrame:
    return first_rows(df, "transaction_region").where(F.col("transaction_region") != F.col("home_region"))


def region_then_payee(df: DataFrame, amount: float = 900.0, hours: int = 24) -> DataFrame:
    """A large transfer to a new payee soon after the account showed up in a new region."""
    regions = (
        _new_regions(df)
        .select("nameOrig", F.col("step").alias("region_step"), F.col("transaction_region").alias("region"))
        .withColumn("_b", F.floor(F.col("region_step") / hours))
        .withColumn("_bkt", F.explode(F.array("_b", F.col("_b") + 1)))
    )
    payees = (
        first_rows(df, "nameDest")
        .where((F.col("type") == "TRANSFER") & (F.col("amount") >= amount))
        .withColumn("_bkt", F.floor(F.col("step") / hours))
    )
    near = F.col("step").between(F.col("region_step"), F.col("region_step") + hours)
    # an account has at most one first row per region, so the fan-out is bounded by the regions
    return (
        payees.join(regions, ["nameOrig", "_bkt"])
        .where(near)
        .groupBy("row_id", "nameOrig", "nameDest", "step", "amount")
        .agg(F.max("region_step").alias("region_step"), F.count("*").alias("new_regions"))
    )


def subscription_creep(df: DataFrame, merchants: int = 3, days: int = 8) -> DataFrame:
    """Several new subscription merchants within days."""
    fresh = first_rows(df, "merchant").where(F.col("type") == "SUBSCRIPTION")
    near = Window.partitionBy("nameOrig", "_bkt").orderBy("step").rangeBetween(-days * 24, 0)
    return (
        lookback_buckets(fresh, "step", days * 24)
        .withColumn("new_merchants", F.count("*").over(near))
        .where(~F.col("_halo") & (F.col("new_merchants") >= merchants))
        .select("row_id", "nameOrig", "merchant", "step", "new_merchants")
    )


def refund_loop(df: DataFrame, days: int = 6, same_amount: bool = True, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Purchase, refund, purchase at one merchant within days."""
    rows = df.where((F.col("type") == "SHOP") | ((F.col("type") == "CASH_IN") & (F.col("category") == "refund"))).select(
        "row_id", "step", "type", "nameOrig", "merchant", F.bround("amount", 2).alias("amount")
    )
    keys = HotKeys(rows, ["nameOrig", "merchant", *(["amount"] if same_amount else [])], "row_id", hot_rows, block_rows)
    order = Window.partitionBy(*keys.keys, "_blk").orderBy("step", "row_id")
    carried = prior_rows(keys.only(rows), keys.keys, ["step", "row_id"], ["type"], 2, "_tail")
    here = F.struct("step", "row_id", "type")
    placed = keys.blocks(rows).withColumn("_l1", F.lag(here, 1).over(order)).withColumn("_l2", F.lag(here, 2).over(order))
    joined = keys.carry(placed, carried, {"_tail": "array<struct<step: bigint, row_id: bigint, type: string>>"})
    back = lambda k: F.try_element_at("_tail", F.lit(-k))  # noqa: E731 - the k-th last row before this block
    first = F.when(F.col("_l2").isNotNull(), F.col("_l2")).when(F.col("_l1").isNotNull(), back(1)).otherwise(back(2))
    return (
        joined.withColumn("_one", F.coalesce("_l1", back(1)))
        .withColumn("_two", first)
        .where((F.col("type") == "SHOP") & (F.col("_one.type") == "CASH_IN") & (F.col("_two.type") == "SHOP"))
        .where(F.col("step") - F.col("_two.step") <= days * 24)
        .select("row_id", "nameOrig", "merchant", "amount", F.col("_two.step").alias("first_step"), "step")
    )


def takeover(df: DataFrame, regions: int = 2, days: int = 22, ratio: float = 0.25) -> DataFrame:
    """A drain preceded by several new regions."""
    fresh = _new_regions(df).select("nameOrig", F.col("step").alias("region_step"))
    pairs = drain_pairs(df, drain_ratio=ratio)
    recent = F.col("region_step").between(F.col("transfer_step") - days * 24, F.col("transfer_step"))
    # an account has at most one first row per region
    return (
        pairs.join(fresh, "nameOrig")
        .where(recent)
        .groupBy("transfer_id", "nameOrig", "transfer_step", "transfer_amount", "cashout_id")
        .agg(F.count("*").alias("new_regions"))
        .where(F.col("new_regions") >= regions)
    )


def bust_out(df: DataFrame, age: float = 0.6, ratio: float = 0.1) -> DataFrame:
    """First near-total drain of an account that has been around for most of the ledger."""
    opened = df.groupBy("nameOrig").agg(F.min("step").alias("opened_step"))
    span = df.agg((F.max("step") - F.min("step")).alias("span")).scalar()
    first = (
        drain_pairs(df, drain_ratio=ratio)
        .groupBy("nameOrig")
        .agg(F.min(F.struct("transfer_step", "transfer_id", "transfer_amount", "cashout_id")).alias("f"))
        .select("nameOrig", "f.*")
    )
    return first.join(opened, "nameOrig").where(F.col("transfer_step") - F.col("opened_step") >= age * span)


def trips(df: DataFrame, rows: int = 4, days: int = 4) -> DataFrame:
    """Rows that complete a stay: several in one foreign region within days.

    Rows are counted per hour first, so a look-back holds at most its hours,
    however many rows an account has.
    """
    away = df.where(F.col("transaction_region") != F.col("home_region")).select("row_id", "nameOrig", "transaction_region", "step")
    place = ["nameOrig", "transaction_region"]
    near = Window.partitionBy(*place, "_bkt").orderBy("step").rangeBetween(-days * 24, 0)
    hourly = (
        lookback_buckets(away.groupBy(*place, "step").agg(F.count("*").alias("n")), "step", days * 24)
        .withColumn("rows_in_region", F.sum("n").over(near))
        .where(~F.col("_halo") & (F.col("rows_in_region") >= rows))
        .select(*place, "step", "rows_in_region")
    )
    return away.join(hourly, [*place, "step"]).select("row_id", *place, "step", "rows_in_region")


def errand_bursts(df: DataFrame, hours: int = 3) -> DataFrame:
    """Hours that end a run of groceries, transport and dining within `hours` hours."""
    wanted = ["groceries", "transport", "dining"]
    hourly = df.where(F.col("category").isin(wanted)).groupBy("nameOrig", "step").agg(
        *[F.max((F.col("category") == c).cast("int")).alias(c) for c in wanted], F.count("*").alias("n")
    )
    near = Window.partitionBy("nameOrig", "_bkt").orderBy("step").rangeBetween(-(hours - 1), 0)
    seen = lookback_buckets(hourly, "step", hours)
    for c in wanted:
        seen = seen.withColumn(f"_{c}", F.max(c).over(near))
    seen = seen.withColumn("charges", F.sum("n").over(near))
    return seen.where(~F.col("_halo") & (F.col("_groceries") + F.col("_transport") + F.col("_dining") == 3)).select("nameOrig", "step", "charges")


def life_events(df: DataFrame, amount: float = 800.0) -> DataFrame:
    """Single large purchases, medical bills and tuition payments."""
    listed = (
        ((F.col("type") == "SHOP") & (F.col("category") == "shopping"))
        | ((F.col("type") == "PAYMENT") & F.col("category").isin("health", "housing"))
    )
    return df.where(listed & (F.col("amount") >= amount)).select("row_id", "nameOrig", "category", "amount")


