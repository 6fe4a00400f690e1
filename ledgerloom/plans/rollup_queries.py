"""Scans, filters, rollups, set operations and paging over the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions import columns as C
from ledgerloom.operators import filters, rollups
from ledgerloom.plans.registry import query
from ledgerloom.plans.sqlkit import (
    CREDIT,
    EXPENSE,
    INCOME,
    REGION_VALUES,
    SAVINGS,
    SPENDING,
    in_list,
    over_ledger,
    rnd,
)
from ledgerloom.sources import conform
from ledgerloom.sources.ledger import ledger
from ledgerloom.sources.tables import table

BY = ["persona_id"]
FOCAL = "focal AS (SELECT * FROM ledger WHERE account_type = 'checking')"
FOCAL_ALL = "focal AS (SELECT * FROM ledger WHERE account_type <> 'background')"
LATEST = "latest AS (SELECT * FROM focal WHERE substr(date, 1, 7) = (SELECT max(substr(date, 1, 7)) FROM ledger))"


def _focal(spark, sf, kind=None):
    return filters.focal(ledger(spark, sf), account_type=kind)


def _latest(spark, sf, kind=None):
    whole = ledger(spark, sf)
    return filters.for_month(filters.focal(whole, account_type=kind), whole)


# ---------------------------------------------------------------- sources
@query("ledger_scan", over_ledger("SELECT * FROM ledger"))
def _(spark, sf):
    return ledger(spark, sf)


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@query(
    "conform_legacy_schema",
    over_ledger(
        """SELECT row_id, step, type, amount, nameOrig, merchant, '' AS persona_id, '' AS persona_archetype,
        'checking' AS account_type, '' AS home_region, 0 AS label_reported_at_step, 0 AS simulation_year FROM ledger"""
    ),
)
def _(spark, sf):
    legacy = ledger(spark, sf).drop(*conform.DEFAULTS)
    return conform.conform(legacy).select(
        "row_id", "step", "type", "amount", "nameOrig", "merchant", "persona_id", "persona_archetype",
        "account_type", "home_region", "label_reported_at_step", "simulation_year",
    )


@query(
    "null_text_to_empty",
    over_ledger("SELECT row_id, coalesce(nullif(anomaly_type, ''), '') AS anomaly_type, coalesce(CASE WHEN type = 'DEBIT' THEN NULL ELSE merchant END, '') AS merchant, amount FROM ledger"),
)
def _(spark, sf):
    holes = ledger(spark, sf).select(
        "row_id",
        F.nullif(F.col("anomaly_type"), F.lit("")).alias("anomaly_type"),
        F.when(F.col("type") != "DEBIT", F.col("merchant")).alias("merchant"),
        "amount",
    )
    return conform.null_text_to_empty(holes)


@query("ledger_in_row_order", over_ledger("SELECT row_id, step, nameOrig, amount FROM ledger ORDER BY row_id"))
def _(spark, sf):
    return ledger(spark, sf).select("row_id", "step", "nameOrig", "amount").orderBy("row_id")


@query(
    "derived_columns",
    over_ledger("SELECT row_id, datetime, date, category_group, isFlaggedFraud, simulation_year FROM ledger"),
)
def _(spark, sf):
    from ledgerloom.sources.ledger import with_derived

    bare = ledger(spark, sf).select("row_id", "step", "category", "amount")
    return with_derived(bare).select("row_id", "datetime", "date", "category_group", "isFlaggedFraud", "simulation_year")


# ---------------------------------------------------------------- filters
@query("focal_checking", over_ledger("SELECT row_id, persona_id, amount FROM focal", FOCAL))
def _(spark, sf):
    return _focal(spark, sf).select("row_id", "persona_id", "amount")


@query("focal_all_accounts", over_ledger("SELECT row_id, persona_id, account_type FROM focal", FOCAL_ALL))
def _(spark, sf):
    return _focal(spark, sf, "all").select("row_id", "persona_id", "account_type")


@query("focal_one_user", over_ledger("SELECT row_id, nameOrig, amount FROM ledger WHERE persona_id = 'U0' AND account_type = 'credit'"))
def _(spark, sf):
    return filters.focal(ledger(spark, sf), "U0", "credit").select("row_id", "nameOrig", "amount")


@query(
    "account_types",
    over_ledger("SELECT DISTINCT persona_id, account_type FROM ledger WHERE account_type <> 'background' ORDER BY 1, 2"),
)
def _(spark, sf):
    return filters.account_types(ledger(spark, sf)).orderBy("persona_id", "account_type")


@query(
    "income_savings_expense_masks",
    over_ledger(f"SELECT row_id, {INCOME} AS income, {SAVINGS} AS savings, {EXPENSE} AS expense, NOT {CREDIT} AS spending FROM ledger"),
)
def _(spark, sf):
    return ledger(spark, sf).select(
        "row_id",
        C.is_income().alias("income"),
        C.is_savings_out().alias("savings"),
        C.is_expense().alias("expense"),
        C.is_spending_view().alias("spending"),
    )


@query("latest_month_rows", over_ledger("SELECT row_id, date, amount FROM latest", FOCAL, LATEST))
def _(spark, sf):
    return _latest(spark, sf).select("row_id", "date", "amount")


_EXPLORE = dict(
    categories=["groceries", "dining", "transport"],
    types=["SHOP", "PAYMENT", "DEBIT"],
    dates=("1996-03-01", "1999-10-31"),
    amounts=(120.0, 1600.0),
    accounts=["checking", "background"],
    search="m1|u4",
)
EXPLORE_SQL = f"""explored AS (SELECT * FROM ledger WHERE category IN {in_list(_EXPLORE['categories'])}
  AND type IN {in_list(_EXPLORE['types'])} AND date BETWEEN '1996-03-01' AND '1999-10-31' AND amount BETWEEN 120 AND 1600
  AND account_type IN ('checking', 'background')
  AND (regexp_matches(merchant, 'm1|u4', 'i') OR regexp_matches(nameOrig, 'm1|u4', 'i')))"""


@query("explorer_filter", over_ledger("SELECT row_id, merchant, nameOrig, category, date, amount FROM explored", EXPLORE_SQL))
def _(spark, sf):
    return filters.explore(ledger(spark, sf), **_EXPLORE).select("row_id", "merchant", "nameOrig", "category", "date", "amount")


@query(
    "explorer_totals",
    over_ledger(
        f"SELECT count(*) AS transactions, coalesce(sum(amount), 0.0) AS total, coalesce(sum(amount) FILTER (NOT {CREDIT}), 0.0) AS spending FROM explored",
        EXPLORE_SQL,
    ),
)
def _(spark, sf):
    return filters.explorer_totals(filters.explore(ledger(spark, sf), **_EXPLORE))


@query(
    "filter_options",
    over_ledger(
        "SELECT "
        + ", ".join(
            f"array_to_string(list_sort(list_distinct(list({c}))), '|') AS {c}_options"
            for c in ["category", "type", "account_type", "transaction_region", "subcategory"]
        )
        + ", min(date) AS min_date, max(date) AS max_date, max(amount) AS max_amount FROM ledger"
    ),
)
def _(spark, sf):
    return filters.filter_options(ledger(spark, sf))


@query("spending_view", over_ledger(f"SELECT type, count(*) AS n, sum(amount) AS total FROM ledger WHERE NOT {CREDIT} GROUP BY type"))
def _(spark, sf):
    return ledger(spark, sf).where(C.is_spending_view()).groupBy("type").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query(
    "label_default",
    over_ledger("SELECT coalesce(nullif(fraud_archetype, ''), 'legitimate') AS label, count(*) AS n FROM ledger GROUP BY 1"),
)
def _(spark, sf):
    return ledger(spark, sf).groupBy(C.label_or_legitimate().alias("label")).agg(F.count("*").alias("n"))


@query("positive_amounts", over_ledger("SELECT count(*) AS n, sum(amount) AS total FROM ledger WHERE amount > 0"))
def _(spark, sf):
    return filters.positive_amounts(ledger(spark, sf)).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query("flag_casts", over_ledger("SELECT row_id, CAST(is_focal_user AS INTEGER) AS focal, CAST(isFraud AS BOOLEAN) AS fraud, CAST(amount AS BIGINT) AS whole FROM ledger"))
def _(spark, sf):
    return ledger(spark, sf).select(
        "row_id",
        F.col("is_focal_user").cast("int").alias("focal"),
        F.col("isFraud").cast("boolean").alias("fraud"),
        F.col("amount").cast("long").alias("whole"),
    )


# ---------------------------------------------------------------- rollups
@query(
    "income_savings_expenses",
    over_ledger(
        f"""SELECT persona_id, coalesce(sum(amount) FILTER ({INCOME}), 0.0) AS income, coalesce(sum(amount) FILTER ({SAVINGS}), 0.0) AS savings,
        coalesce(sum(amount) FILTER ({EXPENSE}), 0.0) AS expenses FROM focal GROUP BY persona_id""",
        FOCAL_ALL,
    ),
)
def _(spark, sf):
    return rollups.income_savings_expenses(_focal(spark, sf, "all"), BY)


MONTHS_SQL = f"""months AS (SELECT persona_id, substr(date, 1, 7) AS month, coalesce(sum(amount) FILTER ({INCOME}), 0.0) AS income,
  coalesce(sum(amount) FILTER ({EXPENSE}), 0.0) AS expenses, coalesce(sum(amount) FILTER ({SAVINGS}), 0.0) AS savings FROM focal GROUP BY 1, 2)"""


@query(
    "monthly_income_expenses",
    over_ledger(
        f"SELECT persona_id, month, {rnd('income', 2)} AS income, {rnd('expenses', 2)} AS expenses, {rnd('income - expenses - savings', 2)} AS net FROM months ORDER BY 1, 2",
        FOCAL_ALL,
        MONTHS_SQL,
    ),
)
def _(spark, sf):
    return rollups.monthly_income_expenses(_focal(spark, sf, "all"), BY).orderBy("persona_id", "month")


@query(
    "month_over_month",
    over_ledger(
        """SELECT persona_id, month, income, expenses, net, income - pi AS income_delta, expenses - pe AS expenses_delta, net - pn AS net_delta,
        CASE WHEN pi IS NULL THEN 'neutral' WHEN income >= pi THEN 'pos' ELSE 'neg' END AS income_tone,
        CASE WHEN pi IS NULL THEN 'neutral' WHEN expenses < pe THEN 'pos' ELSE 'neg' END AS expenses_tone,
        CASE WHEN pi IS NULL THEN 'neutral' WHEN net >= pn THEN 'pos' ELSE 'neg' END AS net_tone FROM lagged""",
        FOCAL_ALL,
        MONTHS_SQL,
        """lagged AS (SELECT persona_id, month, income, expenses, income - expenses - savings AS net,
        lag(income) OVER w AS pi, lag(expenses) OVER w AS pe, lag(income - expenses - savings) OVER w AS pn
        FROM months WINDOW w AS (PARTITION BY persona_id ORDER BY month))""",
    ),
)
def _(spark, sf):
    return rollups.month_over_month(_focal(spark, sf, "all"), BY)


SPEND_SQL = f"spend AS (SELECT persona_id, category, sum(amount) AS amount FROM latest WHERE {EXPENSE} AND category <> 'savings' GROUP BY 1, 2)"


@query(
    "monthly_summary",
    over_ledger(
        f"""SELECT m.persona_id, {rnd('income', 2)} AS income, {rnd('expenses', 2)} AS expenses, {rnd('income - expenses - savings', 2)} AS net,
        {rnd('CASE WHEN income > 0 THEN (income - expenses - savings) / income ELSE 0 END', 4)} AS savings_rate,
        coalesce(t.category, 'none') AS top_category, transaction_count
        FROM (SELECT persona_id, coalesce(sum(amount) FILTER ({INCOME}), 0.0) AS income, coalesce(sum(amount) FILTER ({EXPENSE}), 0.0) AS expenses,
          coalesce(sum(amount) FILTER ({SAVINGS}), 0.0) AS savings, count(*) AS transaction_count FROM latest GROUP BY 1) m
        LEFT JOIN (SELECT persona_id, category, row_number() OVER (PARTITION BY persona_id ORDER BY amount DESC, category DESC) AS rn FROM
          (SELECT persona_id, category, sum(amount) AS amount FROM latest WHERE {EXPENSE} GROUP BY 1, 2)) t ON t.persona_id = m.persona_id AND rn = 1""",
        FOCAL_ALL,
        LATEST,
    ),
)
def _(spark, sf):
    return rollups.monthly_summary(_latest(spark, sf, "all"), BY)


@query(
    "category_breakdown",
    over_ledger(
        f"SELECT persona_id, category, {rnd('amount', 2)} AS amount, {rnd('coalesce(amount / nullif(sum(amount) OVER (PARTITION BY persona_id), 0), 0)', 3)} AS share FROM spend ORDER BY 1, 3 DESC, 2",
        FOCAL_ALL, LATEST, SPEND_SQL,
    ),
)
def _(spark, sf):
    return rollups.category_breakdown(_latest(spark, sf, "all"), BY).orderBy("persona_id", F.desc("amount"), "category")


@query(
    "top_categories",
    over_ledger(
        f"""SELECT category, {rnd('amount', 2)} AS amount, {rnd('amount / sum(amount) OVER ()', 3)} AS share FROM
        (SELECT category, sum(amount) AS amount FROM ledger WHERE {EXPENSE} AND category <> 'savings' GROUP BY 1) ORDER BY amount DESC, category LIMIT 4"""
    ),
)
def _(spark, sf):
    return rollups.category_breakdown(ledger(spark, sf)).orderBy(F.desc("amount"), "category").limit(4)


GOALS_SQL = "goals AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {g}::DOUBLE)" for c, g in K.BUDGETS.items()) + ") AS t(category, goal))"
BUDGET_SQL = f"""status AS (SELECT u.persona_id, g.category, g.goal, {rnd('coalesce(s.amount, 0.0)', 2)} AS spent,
  {rnd('coalesce(s.amount, 0.0)', 2)} / g.goal AS used
  FROM (SELECT DISTINCT persona_id FROM latest) u CROSS JOIN goals g LEFT JOIN spend s ON s.persona_id = u.persona_id AND s.category = g.category)"""


@query(
    "budget_status",
    over_ledger(
        f"SELECT persona_id, category, goal, spent, {rnd('used', 3)} AS pct, used > 1 AS over FROM status ORDER BY persona_id, pct DESC, category",
        FOCAL_ALL, LATEST, SPEND_SQL, GOALS_SQL, BUDGET_SQL,
    ),
)
def _(spark, sf):
    status = rollups.budget_status(_latest(spark, sf, "all"), rollups.budget_goals(spark), BY)
    return status.orderBy("persona_id", F.desc("pct"), "category")


@query(
    "budget_totals",
    over_ledger(
        f"SELECT persona_id, count(*) AS tracked, count(*) FILTER (used > 1) AS over_goal, {rnd('sum(goal)', 2)} AS total_goal, {rnd('sum(spent)', 2)} AS total_spent FROM status GROUP BY 1",
        FOCAL_ALL, LATEST, SPEND_SQL, GOALS_SQL, BUDGET_SQL,
    ),
)
def _(spark, sf):
    return rollups.budget_totals(rollups.budget_status(_latest(spark, sf, "all"), rollups.budget_goals(spark), BY), BY)


DAILY_SQL = f"daily AS (SELECT date, category, sum(amount) AS total FROM ledger WHERE category IN {SPENDING} GROUP BY 1, 2)"


@query("daily_category_totals", over_ledger("SELECT date, category, total FROM daily", DAILY_SQL))
def _(spark, sf):
    return rollups.daily_category_totals(ledger(spark, sf))


@query(
    "category_day_stats",
    over_ledger(f"SELECT category, {rnd('avg(total)', 6)} AS mean, {rnd('coalesce(stddev_samp(total), 0.0)', 6)} AS std FROM daily GROUP BY 1", DAILY_SQL),
)
def _(spark, sf):
    stats = rollups.category_day_stats(rollups.daily_category_totals(ledger(spark, sf)))
    return stats.select("category", C.rnd("mean", 6).alias("mean"), C.rnd("std", 6).alias("std"))


def _recurring_sql(source: str, by: str) -> str:
    keys = f"{by}, merchant" if by else "merchant"
    return f"""recurring AS (
  SELECT {keys}, category, {rnd('mean_amount', 2)} AS amount, {rnd('mean_gap', 1)} AS interval_days, occurrences, last_paid
  FROM (SELECT {keys}, count(*) AS occurrences, avg(amount) AS mean_amount, stddev_pop(amount) AS sd, avg(gap) AS mean_gap,
      stddev_pop(gap) AS sd_gap, max(date) AS last_paid
    FROM (SELECT *, (step - lag(step) OVER (PARTITION BY {keys} ORDER BY step, row_id)) / 24.0::DOUBLE AS gap
      FROM {source} WHERE type IN {in_list(K.RECURRING_TYPES)}) GROUP BY {keys}) a
  JOIN (SELECT {keys}, category FROM (SELECT {keys}, category, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, category) AS rn
      FROM {source} WHERE type IN {in_list(K.RECURRING_TYPES)} GROUP BY {keys}, category) WHERE rn = 1) m USING ({keys})
  WHERE occurrences >= 3 AND mean_amount > 0 AND sd / mean_amount <= 0.7
    AND coalesce(sd_gap / nullif(mean_gap, 0), 1.0) <= 1.2)"""


@query(
    "recurring_payments",
    over_ledger("SELECT * FROM recurring", "focal AS (SELECT * FROM ledger WHERE is_focal_user)", _recurring_sql("focal", "")),
)
def _(spark, sf):
    focal = ledger(spark, sf).where("is_focal_user")
    return rollups.recurring_payments(focal, max_amount_cv=0.7, max_interval_cv=1.2)


@query(
    "recurring_totals_by_persona",
    over_ledger(
        f"SELECT persona_id, count(*) AS payments, {rnd('sum(amount)', 2)} AS monthly_total FROM recurring GROUP BY 1",
        "focal AS (SELECT * FROM ledger WHERE is_focal_user)",
        _recurring_sql("focal", "persona_id"),
    ),
)
def _(spark, sf):
    focal = ledger(spark, sf).where("is_focal_user")
    return rollups.recurring_totals(rollups.recurring_payments(focal, BY, max_amount_cv=0.7, max_interval_cv=1.2), BY)


HEALTH_SQL = f"""health AS (
  SELECT persona_id, CAST({rnd('100.0::DOUBLE * (0.30::DOUBLE * least(greatest(sr / 0.20::DOUBLE, 0), 1) + 0.20::DOUBLE * least(greatest(1.0::DOUBLE - sub / 0.05::DOUBLE, 0), 1) + 0.15::DOUBLE * least(greatest(1.0::DOUBLE - share / 0.40::DOUBLE, 0), 1) + 0.20::DOUBLE * least(greatest(buffer / 6.0::DOUBLE, 0), 1) + 0.15::DOUBLE * least(greatest(1.0::DOUBLE - abs(0.5::DOUBLE - sr) * 2.0::DOUBLE, 0), 1))', 0)} AS INTEGER) AS score,
    {rnd('mi', 2)} AS monthly_income, {rnd('me', 2)} AS monthly_expenses, {rnd('ms', 2)} AS monthly_savings, {rnd('sr', 3)} AS savings_rate,
    {rnd('sub', 3)} AS subscription_ratio, {rnd('share', 3)} AS top_category_share, {rnd('buffer', 1)} AS buffer_months
  FROM (SELECT *, CASE WHEN mi > 0 THEN ms / mi ELSE 0.0 END AS sr, CASE WHEN mi > 0 THEN subs / m / mi ELSE 1.0 END AS sub,
      CASE WHEN me > 0 THEN coalesce(top / m / me, 1.0) ELSE 1.0 END AS share, CASE WHEN me > 0 THEN net / me ELSE 0.0 END AS buffer
    FROM (SELECT *, income / m AS mi, expenses / m AS me, (income - expenses - savings) / m AS ms, income - expenses - savings AS net
      FROM (SELECT persona_id, CAST(count(DISTINCT substr(date, 1, 7)) AS DOUBLE) AS m, coalesce(sum(amount) FILTER ({CREDIT}), 0.0) AS income,
          coalesce(sum(amount) FILTER ({EXPENSE}), 0.0) AS expenses, coalesce(sum(amount) FILTER ({SAVINGS}), 0.0) AS savings,
          coalesce(sum(amount) FILTER (category = 'subscriptions'), 0.0) AS subs FROM focal WHERE is_focal_user GROUP BY 1) a
      LEFT JOIN (SELECT persona_id, max(amount) AS top FROM (SELECT persona_id, category, sum(amount) AS amount FROM focal
          WHERE is_focal_user AND {EXPENSE} AND category <> 'savings' GROUP BY 1, 2) GROUP BY 1) t USING (persona_id))))"""


def _health(spark, sf):
    return rollups.financial_health(_focal(spark, sf).where("is_focal_user"), BY)


@query("financial_health", over_ledger("SELECT * FROM health", FOCAL, HEALTH_SQL))
def _(spark, sf):
    return _health(spark, sf)


FORECAST_SQL = f"""forecast AS (
  SELECT persona_id, count(*) AS months, {rnd('greatest(0.0, arg_max(income, month) + coalesce(regr_slope(income, x), 0.0))', 2)} AS forecast_income,
    {rnd('greatest(0.0, arg_max(expenses, month) + coalesce(regr_slope(expenses, x), 0.0))', 2)} AS forecast_expenses,
    {rnd('greatest(0.0, arg_max(income, month) + coalesce(regr_slope(income, x), 0.0)) - greatest(0.0, arg_max(expenses, month) + coalesce(regr_slope(expenses, x), 0.0))', 2)} AS forecast_net,
    CASE WHEN coalesce(regr_slope(expenses, x), 0.0) > 0 THEN 'rising' WHEN coalesce(regr_slope(expenses, x), 0.0) < 0 THEN 'falling' ELSE 'stable' END AS trend
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY persona_id ORDER BY month) - 1 AS DOUBLE) AS x FROM
    (SELECT persona_id, substr(date, 1, 7) AS month, coalesce(sum(amount) FILTER ({CREDIT}), 0.0) AS income,
      coalesce(sum(amount) FILTER ({EXPENSE}), 0.0) AS expenses FROM focal GROUP BY 1, 2)) GROUP BY 1)"""


@query("forecast_next_month", over_ledger("SELECT * FROM forecast", FOCAL, FORECAST_SQL))
def _(spark, sf):
    return rollups.forecast_next_month(_focal(spark, sf), BY)


@query(
    "weekly_digest",
    over_ledger(
        f"""SELECT f.persona_id, CAST(s AS VARCHAR) AS "start", CAST(e AS VARCHAR) AS "end", {rnd(f'coalesce(sum(amount) FILTER ({CREDIT}), 0.0)', 2)} AS income,
        {rnd(f'coalesce(sum(amount) FILTER ({EXPENSE}), 0.0)', 2)} AS expenses,
        {rnd(f'coalesce(sum(amount) FILTER ({CREDIT}), 0.0) - coalesce(sum(amount) FILTER ({EXPENSE}), 0.0)', 2)} AS net
        FROM focal f JOIN win USING (persona_id) WHERE CAST(date AS DATE) BETWEEN s AND e GROUP BY 1, 2, 3""",
        FOCAL,
        f"""win AS (SELECT persona_id, e, CASE WHEN coalesce(lc < e - 6, true) AND ls >= e - 35 THEN least(e - 6, ls) ELSE e - 6 END AS s
        FROM (SELECT persona_id, max(CAST(date AS DATE)) AS e, max(CAST(date AS DATE)) FILTER (type = 'SALARY') AS ls,
          max(CAST(date AS DATE)) FILTER ({CREDIT}) AS lc FROM focal GROUP BY 1))""",
    ),
)
def _(spark, sf):
    return rollups.digest(_focal(spark, sf), BY)


@query(
    "persona_manifest",
    over_ledger(
        """SELECT persona_id, arg_min(persona_archetype, row_id) AS archetype, count(*) AS transactions, CAST(sum(isFraud) AS BIGINT) AS fraud_count,
        arg_min(home_region, row_id) AS home_region FROM ledger WHERE is_focal_user GROUP BY 1"""
    ),
)
def _(spark, sf):
    return rollups.persona_manifest(ledger(spark, sf))


@query(
    "dataset_profile",
    over_ledger(
        f"""SELECT count(*) AS transactions, CAST(sum(isFraud) AS BIGINT) AS fraud, {rnd('CAST(sum(isFraud) AS DOUBLE) / count(*)', 6)} AS fraud_rate,
        CAST(sum(is_anomaly) AS BIGINT) AS anomalies, CAST(count(*) FILTER (is_focal_user) AS BIGINT) AS focal_transactions, count(DISTINCT persona_id) AS personas FROM ledger"""
    ),
)
def _(spark, sf):
    return rollups.dataset_profile(ledger(spark, sf))


@query("archetype_counts", over_ledger("SELECT fraud_archetype, count(*) AS fraud FROM ledger WHERE isFraud = 1 GROUP BY 1 ORDER BY 1"))
def _(spark, sf):
    return rollups.archetype_counts(ledger(spark, sf)).orderBy("fraud_archetype")


# ---------------------------------------------------------------- sorting, paging, sets
@query("ledger_page", over_ledger("SELECT row_id, date, merchant, amount FROM ledger ORDER BY row_id LIMIT 200 OFFSET 1000"))
def _(spark, sf):
    return filters.page(ledger(spark, sf).select("row_id", "date", "merchant", "amount"), 200, 1000)


@query(
    "ledger_page_totals",
    over_ledger("SELECT count(*) AS total, least(count(*), 5000) AS shown, count(*) > 5000 AS truncated FROM ledger"),
)
def _(spark, sf):
    total = F.count("*")
    return ledger(spark, sf).agg(total.alias("total"), F.least(total, F.lit(5000)).alias("shown"), (total > 5000).alias("truncated"))


@query("keyset_page", over_ledger("SELECT row_id, date, merchant, amount FROM ledger WHERE row_id > 2999 ORDER BY row_id LIMIT 500"))
def _(spark, sf):
    return filters.page_after(ledger(spark, sf).select("row_id", "date", "merchant", "amount"), 2999, 500)


@query("newest_first", over_ledger("SELECT datetime, row_id, merchant, amount FROM ledger ORDER BY datetime DESC, row_id LIMIT 100"))
def _(spark, sf):
    return ledger(spark, sf).select("datetime", "row_id", "merchant", "amount").orderBy(F.desc("datetime"), "row_id").limit(100)


@query(
    "union_of_frames",
    over_ledger("SELECT src, count(*) AS n, sum(amount) AS total FROM (SELECT 'focal' AS src, amount FROM ledger WHERE is_focal_user UNION ALL SELECT 'background', amount FROM ledger WHERE account_type = 'background') GROUP BY 1"),
)
def _(spark, sf):
    whole = ledger(spark, sf)
    both = whole.where("is_focal_user").select(F.lit("focal").alias("src"), "amount").unionByName(
        whole.where(F.col("account_type") == "background").select(F.lit("background").alias("src"), "amount")
    )
    return both.groupBy("src").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query("distinct_months", over_ledger("SELECT DISTINCT substr(date, 1, 7) AS month FROM ledger ORDER BY 1"))
def _(spark, sf):
    return ledger(spark, sf).select(C.month_of().alias("month")).distinct().orderBy("month")


@query(
    "unused_regions",
    over_ledger(
        f"SELECT region_id FROM (VALUES {REGION_VALUES}) AS t(region_id, city, state, lat, lon) EXCEPT SELECT transaction_region FROM ledger WHERE account_type = 'credit' AND type = 'SALARY' AND amount > 1800"
    ),
)
def _(spark, sf):
    used = ledger(spark, sf).where((F.col("account_type") == "credit") & (F.col("type") == "SALARY") & (F.col("amount") > 1800))
    return C.regions(spark).select("region_id").subtract(used.select("transaction_region"))


@query(
    "personas_in_both_years",
    over_ledger("SELECT persona_id FROM ledger WHERE simulation_year = 1996 AND type = 'SALARY' INTERSECT SELECT persona_id FROM ledger WHERE simulation_year = 2000 AND type = 'SALARY'"),
)
def _(spark, sf):
    salary = ledger(spark, sf).where(F.col("type") == "SALARY")
    return salary.where("simulation_year = 1996").select("persona_id").intersect(salary.where("simulation_year = 2000").select("persona_id"))


@query(
    "account_keys_union",
    over_ledger("SELECT nameOrig AS account FROM ledger UNION SELECT nameDest FROM ledger WHERE type = 'TRANSFER'"),
)
def _(spark, sf):
    whole = ledger(spark, sf)
    return whole.select(F.col("nameOrig").alias("account")).union(whole.where(F.col("type") == "TRANSFER").select("nameDest")).distinct()


