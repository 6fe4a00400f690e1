"""Monthly and category rollups, budgets, health, forecast and digests.

Every rollup takes `by`, the grouping of its caller: () for the frame of one
user, ("persona_id",) to answer for all users in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions import columns as C

By = Sequence[str]


def income_savings_expenses(df: DataFrame, by: By = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        C.sum_if(C.is_income()).alias("income"),
        C.sum_if(C.is_savings_out()).alias("savings"),
        C.sum_if(C.is_expense()).alias("expenses"),
    )


def monthly_income_expenses(df: DataFrame, by: By = ()) -> DataFrame:
    months = income_savings_expenses(df.withColumn("month", C.month_of()), [*by, "month"])
    return months.select(
        *by,
        "month",
        C.rnd("income", 2).alias("income"),
        C.rnd("expenses", 2).alias("expenses"),
        C.rnd(F.col("income") - F.col("expenses") - F.col("savings"), 2).alias("net"),
    )


def month_over_month(df: DataFrame, by: By = ()) -> DataFrame:
    """Change of each monthly figure against the previous month, with its tone.

    Rising expenses are bad news, so their tone is inverted.
    """
    months = monthly_income_expenses(df, by)
    order = Window.partitionBy(*by).orderBy("month")
    out = months
    for name, inverted in (("income", False), ("expenses", True), ("net", False)):
        change = F.col(name) - F.lag(name).over(order)
        good = (change < 0) if inverted else (change >= 0)
        out = out.withColumn(f"{name}_delta", change).withColumn(
            f"{name}_tone", F.when(change.isNull(), "neutral").when(good, "pos").otherwise("neg")
        )
    return out


def _spend_by_category(df: DataFrame, by: By) -> DataFrame:
    return (
        df.where(C.is_expense() & (F.col("category") != "savings"))
        .groupBy(*by, "category")
        .agg(F.sum("amount").alias("amount"))
    )


def monthly_summary(df: DataFrame, by: By = ()) -> DataFrame:
    """Totals of one month's rows per group, with the largest expense category."""
    keys = [*by, "category"]
    per_category = df.groupBy(*keys).agg(
        C.sum_if(C.is_income()).alias("income"),
        C.sum_if(C.is_savings_out()).alias("savings"),
        C.sum_if(C.is_expense()).alias("expenses"),
        F.sum(F.when(C.is_expense(), F.lit(1)).otherwise(F.lit(0))).alias("expense_rows"),
        F.count("*").alias("n"),
    )
    spent = F.when(F.col("expense_rows") > 0, F.struct(F.col("expenses"), F.col("category")))
    total = per_category.groupBy(*by).agg(
        F.sum("income").alias("income"),
        F.sum("savings").alias("savings"),
        F.sum("expenses").alias("expenses"),
        # equal totals: the alphabetically last category wins, deterministically
        F.coalesce(F.max(spent)["category"], F.lit("none")).alias("top_category"),
        F.sum("n").alias("transaction_count"),
    )
    net = F.col("income") - F.col("expenses") - F.col("savings")
    return total.select(
        *by,
        C.rnd("income", 2).alias("income"),
        C.rnd("expenses", 2).alias("expenses"),
        C.rnd(net, 2).alias("net"),
        C.rnd(F.when(F.col("income") > 0, F.try_divide(net, F.col("income"))).otherwise(F.lit(0.0)), 4).alias("savings_rate"),
        "top_category",
        "transaction_count",
    )


def category_breakdown(df: DataFrame, by: By = ()) -> DataFrame:
    """Spend and share per category; the share window runs over a handful of rows."""
    total = F.sum("amount").over(Window.partitionBy(*by))
    return _spend_by_category(df, by).select(
        *by,
        "category",
        C.rnd("amount", 2).alias("amount"),
        C.rnd(F.coalesce(F.try_divide(F.col("amount"), total), F.lit(0.0)), 3).alias("share"),
    )


def budget_goals(spark: SparkSession, goals: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(list((goals or K.BUDGETS).items()), "category string, goal double")


def budget_status(df: DataFrame, goals: DataFrame, by: By = ()) -> DataFrame:
    """Spend against each goal; goals without spending stay with zero."""
    spend = _spend_by_category(df, by)
    if by:
        # one row per (group, goal): goals are a fixed short list, unfolded in place
        wanted = goals.agg(F.collect_list(F.struct("category", "goal")).alias("goals")).scalar()
        frame = (
            df.select(*by).distinct().withColumn("g", F.explode(wanted)).select(*by, "g.category", "g.goal")
        )
    else:
        frame = goals
    joined = frame.join(spend, [*by, "category"], "left")
    spent = C.rnd(F.coalesce("amount", F.lit(0.0)), 2)
    pct = F.when(F.col("goal") > 0, F.try_divide(F.col("spent"), F.col("goal"))).otherwise(F.lit(0.0))
    return (
        joined.withColumn("spent", spent)
        .withColumn("used", pct)
        .select(*by, "category", "goal", "spent", C.rnd("used", 3).alias("pct"), (F.col("used") > 1).alias("over"))
    )


def budget_totals(status: DataFrame, by: By = ()) -> DataFrame:
    return status.groupBy(*by).agg(
        F.count("*").alias("tracked"),
        F.count_if("over").alias("over_goal"),
        C.rnd(F.sum("goal"), 2).alias("total_goal"),
        C.rnd(F.sum("spent"), 2).alias("total_spent"),
    )


def daily_category_totals(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("category").isin(K.SPENDING_CATEGORIES))
        .groupBy("date", "category")
        .agg(F.sum("amount").alias("total"))
    )


def category_day_stats(daily: DataFrame) -> DataFrame:
    """Mean and sample deviation of the daily totals per category."""
    return daily.groupBy("category").agg(
        F.avg("total").alias("mean"),
        F.coalesce(F.stddev_samp("total"), F.lit(0.0)).alias("std"),
    )


def recurring_payments(
    df: DataFrame,
    by: By = (),
    min_occurrences: int = 3,
    max_amount_cv: float = 0.25,
    max_interval_cv: float = 0.35,
) -> DataFrame:
    """Merchants paid stable amounts at stable intervals.

    Gaps between equal steps are zero, so the ordered pass runs over the
    distinct (merchant, step) pairs: at most one row per hour and merchant,
    whatever share of all rows one merchant holds. Gap moments are whole
    numbers of hours, hence exact.
    """
    keys = [*by, "merchant"]
    rows = df.where(F.col("type").isin(K.RECURRING_TYPES))
    order = Window.partitionBy(*keys).orderBy("step")
    steps = rows.groupBy(*keys, "step").agg(F.lit(1).alias("_one"))
    gaps = (
        steps.withColumn("gap", F.col("step") - F.lag("step").over(order))
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum("gap"), F.lit(0)).cast("double").alias("gap_sum"),
            F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0)).cast("double").alias("gap_squares"),
        )
    )
    paid = rows.groupBy(*keys).agg(
        F.count("*").alias("occurrences"),
        F.avg("amount").alias("mean_amount"),
        F.stddev_pop("amount").alias("std_amount"),
        F.mode("category", True).alias("category"),
        F.max("date").alias("last_paid"),
    )
    n = F.col("occurrences") - 1
    spread = F.sqrt(F.greatest(n * F.col("gap_squares") - F.col("gap_sum") * F.col("gap_sum"), F.lit(0.0)))
    return (
        paid.where((F.col("occurrences") >= min_occurrences) & (F.col("mean_amount") > 0))
        .join(gaps, keys)
        .withColumn("cv_amount", F.col("std_amount") / F.col("mean_amount"))
        .withColumn("cv_gap", F.coalesce(F.try_divide(spread, F.col("gap_sum")), F.lit(1.0)))
        .where((F.col("cv_amount") <= max_amount_cv) & (F.col("cv_gap") <= max_interval_cv))
        .select(
            *keys,
            "category",
            C.rnd("mean_amount", 2).alias("amount"),
            C.rnd(F.col("gap_sum") / 24.0 / n, 1).alias("interval_days"),
            "occurrences",
            "last_paid",
        )
    )


def recurring_totals(recurring: DataFrame, by: By = ()) -> DataFrame:
    return recurring.groupBy(*by).agg(
        F.count("*").alias("payments"), C.rnd(F.sum("amount"), 2).alias("monthly_total")
    )


def spike_summary(spikes: DataFrame) -> DataFrame:
    return spikes.agg(
        F.count("*").alias("transactions"),
        C.rnd(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("total"),
        F.array_join(F.sort_array(F.collect_set("category")), ", ").alias("categories"),
    )


def financial_health(df: DataFrame, by: By = ()) -> DataFrame:
    """Score 0..100 from savings rate, subscription load, concentration and buffer."""
    keys = [*by, "month", "category"]
    cell = df.withColumn("month", C.month_of()).groupBy(*keys).agg(
        C.sum_if(C.is_income(account=False)).alias("income"),
        C.sum_if(C.is_savings_out()).alias("savings"),
        C.sum_if(C.is_expense()).alias("expenses"),
        F.sum("amount").alias("amount"),
    )
    # category totals first, then the group: months are counted as a distinct set
    per_category = cell.groupBy(*by, "category").agg(
        F.sum("income").alias("income"),
        F.sum("savings").alias("savings"),
        F.sum("expenses").alias("expenses"),
        F.sum("amount").alias("amount"),
        F.collect_set("month").alias("months"),
    )
    total = per_category.groupBy(*by).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("months")))).alias("months"),
        F.sum("income").alias("income"),
        F.sum("savings").alias("savings"),
        F.sum("expenses").alias("expenses"),
        C.sum_if(F.col("category") == "subscriptions").alias("subscriptions"),
        F.max(F.when((F.col("category") != "savings") & (F.col("expenses") > 0), F.col("expenses"))).alias("top"),
    )
    m = F.col("months")
    net = F.col("income") - F.col("expenses") - F.col("savings")
    monthly = (
        total.withColumn("m_income", F.col("income") / m)
        .withColumn("m_expenses", F.col("expenses") / m)
        .withColumn("m_savings", net / m)
        .withColumn("sr", F.when(F.col("income") > 0, F.try_divide(F.col("m_savings"), F.col("m_income"))).otherwise(F.lit(0.0)))
        .withColumn(
            "sub",
            F.when(F.col("income") > 0, F.try_divide(F.col("subscriptions") / m, F.col("m_income"))).otherwise(F.lit(1.0)),
        )
        .withColumn("share", F.coalesce(F.try_divide(F.col("top") / m, F.col("m_expenses")), F.lit(1.0)))
        .withColumn("buffer", F.coalesce(F.try_divide(net, F.col("m_expenses")), F.lit(0.0)))
    )
    score = 100.0 * (
        0.30 * C.clamp(F.col("sr") / 0.20)
        + 0.20 * C.clamp(1.0 - F.col("sub") / 0.05)
        + 0.15 * C.clamp(1.0 - F.col("share") / 0.40)
        + 0.20 * C.clamp(F.col("buffer") / 6.0)
        + 0.15 * C.clamp(1.0 - F.abs(0.5 - F.col("sr")) * 2.0)
    )
    return monthly.select(
        *by,
        F.bround(score, 0).cast("int").alias("score"),
        C.rnd("m_income", 2).alias("monthly_income"),
        C.rnd("m_expenses", 2).alias("monthly_expenses"),
        C.rnd("m_savings", 2).alias("monthly_savings"),
        C.rnd("sr", 3).alias("savings_rate"),
        C.rnd("sub", 3).alias("subscription_ratio"),
        C.rnd("share", 3).alias("top_category_share"),
        C.rnd("buffer", 1).alias("buffer_months"),
    )


def forecast_next_month(df: DataFrame, by: By = ()) -> DataFrame:
    """Last month plus the least-squares slope over the month index, floored at zero."""
    months = df.groupBy(*by, C.month_of().alias("month")).agg(
        C.sum_if(C.is_income(account=False)).alias("income"), C.sum_if(C.is_expense()).alias("expenses")
    )
    order = Window.partitionBy(*by).orderBy("month")
    indexed = months.withColumn("x", (F.row_number().over(order) - 1).cast("double"))
    fitted = indexed.groupBy(*by).agg(
        F.count("*").alias("months"),
        F.max_by("income", "month").alias("last_income"),
        F.max_by("expenses", "month").alias("last_expenses"),
        F.coalesce(F.regr_slope("income", "x"), F.lit(0.0)).alias("si"),
        F.coalesce(F.regr_slope("expenses", "x"), F.lit(0.0)).alias("se"),
    )
    f_income = F.greatest(F.lit(0.0), F.col("last_income") + F.col("si"))
    f_expenses = F.greatest(F.lit(0.0), F.col("last_expenses") + F.col("se"))
    return fitted.select(
        *by,
        "months",
        C.rnd(f_income, 2).alias("forecast_income"),
        C.rnd(f_expenses, 2).alias("forecast_expenses"),
        C.rnd(f_income - f_expenses, 2).alias("forecast_net"),
        F.when(F.col("se") > 0, "rising").when(F.col("se") < 0, "falling").otherwise("stable").alias("trend"),
    )


def digest(df: DataFrame, by: By = ()) -> DataFrame:
    """Trailing week per group; reaches back to the last payday if the week had no income.

    The net leaves savings transfers out, unlike the monthly net.
    """
    # one row per group and day carries everything, so no group is ever gathered
    daily = df.groupBy(*by, F.to_date("date").alias("day")).agg(
        C.sum_if(C.is_income(account=False)).alias("income"),
        C.sum_if(C.is_expense()).alias("expenses"),
        F.max(F.col("type") == "SALARY").alias("salary"),
        F.max(F.col("type").isin(K.CREDIT_TYPES)).alias("credit"),
    )
    bounds = daily.groupBy(*by).agg(
        F.max("day").alias("end"),
        F.max(F.when(F.col("salary"), F.col("day"))).alias("last_salary"),
        F.max(F.when(F.col("credit"), F.col("day"))).alias("last_credit"),
    )
    week = F.date_sub("end", 6)
    extend = F.coalesce(F.col("last_credit") < week, F.lit(True)) & (F.col("last_salary") >= F.date_sub("end", 35))
    window = bounds.select(
        *by, "end", F.when(extend, F.least(week, F.col("last_salary"))).otherwise(week).alias("start")
    )
    if by:
        scoped = daily.join(window, list(by))
    else:
        scoped = daily.withColumns({c: window.select(c).scalar() for c in ("start", "end")})
    return (
        scoped.where(F.col("day") >= F.col("start"))
        .groupBy(*by, "start", "end")
        .agg(F.sum("income").alias("income"), F.sum("expenses").alias("expenses"))
        .select(
            *by,
            F.col("start").cast("string").alias("start"),
            F.col("end").cast("string").alias("end"),
            C.rnd("income", 2).alias("income"),
            C.rnd("expenses", 2).alias("expenses"),
            C.rnd(F.col("income") - F.col("expenses"), 2).alias("net"),
        )
    )


def persona_manifest(df: DataFrame) -> DataFrame:
    return (
        df.where("is_focal_user")
        .groupBy("persona_id")
        .agg(
            F.min_by("persona_archetype", "row_id").alias("archetype"),
            F.count("*").alias("transactions"),
            F.sum(F.col("isFraud").cast("long")).alias("fraud_count"),
            F.min_by("home_region", "row_id").alias("home_region"),
        )
    )


def dataset_profile(df: DataFrame) -> DataFrame:
    """Whole-ledger counts. Distinct personas come from a pre-aggregate, so the
    scan itself is one pass with partial aggregation."""
    per_persona = df.groupBy("persona_id").agg(
        F.count("*").alias("n"),
        F.sum(F.col("isFraud").cast("long")).alias("fraud"),
        F.sum(F.col("is_anomaly").cast("long")).alias("anomalies"),
        F.sum(F.col("is_focal_user").cast("long")).alias("focal"),
    )
    return per_persona.agg(
        F.sum("n").alias("transactions"),
        F.sum("fraud").alias("fraud"),
        C.rnd(F.try_divide(F.sum("fraud").cast("double"), F.sum("n").cast("double")), 6).alias("fraud_rate"),
        F.sum("anomalies").alias("anomalies"),
        F.sum("focal").alias("focal_transactions"),
        F.count("*").alias("personas"),
    )


def archetype_counts(df: DataFrame) -> DataFrame:
    return df.where(F.col("isFraud") == 1).groupBy("fraud_archetype").agg(F.count("*").alias("fraud"))


def tips(health: DataFrame, forecast: DataFrame, flagged: Column, by: By = ()) -> DataFrame:
    """Which advice applies, with the figures it quotes."""
    joined = health.join(forecast, list(by)) if by else health.withColumns(
        {c: forecast.select(c).scalar() for c in ("forecast_expenses",)}
    )
    first = (
        F.when(F.col("savings_rate") < K.SAVINGS_RATE_GOAL, "raise_savings")
        .when(F.col("subscription_ratio") > K.SUBSCRIPTION_RATIO_LIMIT, "trim_subscriptions")
        .otherwise("keep_it_up")
    )
    return joined.select(*by, first.alias("tip"), "savings_rate", "subscription_ratio", flagged.alias("flagged"), "forecast_expenses")
