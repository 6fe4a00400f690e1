"""As-of join, detectors, rule score, features and risk scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions import columns as C
from ledgerloom.operators import filters, rollups, rules
from ledgerloom.operators.asof import asof_forward
from ledgerloom.operators.features import FEATURES, build_features
from ledgerloom.plans.registry import query
from ledgerloom.plans.rollup_queries import BY, DAILY_SQL, FOCAL, FORECAST_SQL, HEALTH_SQL
from ledgerloom.plans.sqlkit import REGION_VALUES, in_list, over_ledger, rnd
from ledgerloom.sources.ledger import ledger

# ---------------------------------------------------------------- as-of join
NEAREST_SQL = """cash AS (SELECT nameOrig AS key, step, arg_min(amount, row_id) AS amount, min(row_id) AS row_id FROM ledger WHERE type = 'CASH_OUT' GROUP BY 1, 2),
paired AS (SELECT t.*, c.row_id AS cashout_id, c.step AS cashout_step, c.amount AS cashout_amount
  FROM (SELECT * FROM ledger WHERE type = 'TRANSFER') t ASOF LEFT JOIN cash c ON t.nameDest = c.key AND t.step < c.step)"""


@query(
    "asof_next_cashout",
    over_ledger(
        "SELECT row_id, step, nameDest, CASE WHEN cashout_step - step <= 6 THEN cashout_id END AS cashout_id, CASE WHEN cashout_step - step <= 6 THEN cashout_step END AS cashout_step FROM paired",
        NEAREST_SQL,
    ),
)
def _(spark, sf):
    rows = ledger(spark, sf)
    transfers = rows.where(F.col("type") == "TRANSFER").select("row_id", "step", "nameDest", F.col("nameDest").alias("key"))
    cash = rows.where(F.col("type") == "CASH_OUT").select("row_id", "step", "amount", F.col("nameOrig").alias("key"))
    return asof_forward(transfers, cash, "key", "step", ["amount"], 6).select(
        "row_id", "step", "nameDest", F.col("match.row_id").alias("cashout_id"), F.col("match.step").alias("cashout_step")
    )


PAIRS_SQL = """pairs AS (SELECT row_id AS transfer_id, step AS transfer_step, amount AS transfer_amount, nameOrig, nameDest AS destination,
  cashout_id, cashout_step, cashout_amount FROM paired
  WHERE amount >= 500 AND oldbalanceOrg > 0 AND newbalanceOrig <= 0.5::DOUBLE * oldbalanceOrg AND cashout_step - step <= 6 AND cashout_amount >= 0.9::DOUBLE * amount)"""


@query("balance_drain_pairs", over_ledger("SELECT * FROM pairs", NEAREST_SQL, PAIRS_SQL))
def _(spark, sf):
    return rules.drain_pairs(ledger(spark, sf))


SHOWN = "row_id, step, amount, nameOrig, nameDest, category, merchant"
DRAIN_ROWS_SQL = "drained AS (SELECT transfer_id AS row_id FROM pairs UNION SELECT cashout_id FROM pairs)"
DRAIN_VALUES_SQL = """drained_values AS (SELECT transfer_step AS step, nameOrig, round_even(transfer_amount, 2) AS amt FROM pairs
  UNION SELECT cashout_step, destination, round_even(cashout_amount, 2) FROM pairs)"""


@query(
    "balance_drain_rows",
    over_ledger(f"SELECT {SHOWN}, 'balance_drain' AS reason FROM ledger WHERE row_id IN (SELECT row_id FROM drained)", NEAREST_SQL, PAIRS_SQL, DRAIN_ROWS_SQL),
)
def _(spark, sf):
    return rules.balance_drains(ledger(spark, sf))


@query(
    "balance_drain_by_values",
    over_ledger(
        """SELECT row_id, l.step, amount, l.nameOrig, nameDest, category, merchant, 'balance_drain' AS reason FROM ledger l
        SEMI JOIN drained_values d ON l.step = d.step AND l.nameOrig = d.nameOrig AND round_even(amount, 2) = amt""",
        NEAREST_SQL, PAIRS_SQL, DRAIN_VALUES_SQL,
    ),
)
def _(spark, sf):
    return rules.balance_drains(ledger(spark, sf), match_on="values")


# ---------------------------------------------------------------- duplicates and spikes
def _dups_sql(keys: str) -> str:
    return f"""dups AS (SELECT * FROM (SELECT *, step - lag(step) OVER (PARTITION BY {keys} ORDER BY step, row_id) AS gap
      FROM ledger WHERE is_focal_user AND type IN {in_list(K.DUPLICATE_TYPES)}) WHERE gap BETWEEN 0 AND 48)"""


DUPS_SQL = _dups_sql("merchant, round_even(amount, 2)")


@query("duplicate_charges", over_ledger("SELECT row_id, step, amount, merchant, category, 'duplicate_charge' AS reason FROM dups", DUPS_SQL))
def _(spark, sf):
    return rules.duplicate_charges(ledger(spark, sf))


@query(
    "duplicate_charges_by_account",
    over_ledger(
        "SELECT row_id, step, amount, merchant, category, 'duplicate_charge' AS reason FROM dups",
        _dups_sql("merchant, round_even(amount, 2), nameOrig").replace("BETWEEN 0 AND 48", "BETWEEN 0 AND 720"),
    ),
)
def _(spark, sf):
    return rules.duplicate_charges(ledger(spark, sf), window_days=30, by_account=True)


SPIKE_DAYS_SQL = """spike_days AS (SELECT date, category, total FROM (SELECT *, (total - avg(total) OVER w) / nullif(stddev_samp(total) OVER w, 0) AS z
  FROM daily WINDOW w AS (PARTITION BY category)) WHERE z >= 3.0)"""
SPIKES_SQL = "spikes AS (SELECT l.* FROM ledger l JOIN spike_days USING (date, category))"


@query("spike_days", over_ledger("SELECT date, category, total FROM spike_days", DAILY_SQL, SPIKE_DAYS_SQL))
def _(spark, sf):
    return rules.spike_days(ledger(spark, sf)).select("date", "category", "total")


@query(
    "spend_spikes",
    over_ledger("SELECT row_id, step, date, amount, category, merchant, 'spend_spike' AS reason FROM spikes", DAILY_SQL, SPIKE_DAYS_SQL, SPIKES_SQL),
)
def _(spark, sf):
    return rules.spend_spikes(ledger(spark, sf))


@query(
    "spend_spikes_trailing",
    over_ledger(
        "SELECT row_id, step, date, amount, category, merchant, 'spend_spike' AS reason FROM spikes",
        DAILY_SQL,
        SPIKE_DAYS_SQL.replace("(PARTITION BY category)", "(PARTITION BY category ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
        SPIKES_SQL,
    ),
)
def _(spark, sf):
    return rules.spend_spikes(ledger(spark, sf), trailing=True)


@query(
    "spend_spike_summary",
    over_ledger(
        f"SELECT count(*) AS transactions, {rnd('coalesce(sum(amount), 0.0)', 2)} AS total, array_to_string(list_sort(list_distinct(list(category))), ', ') AS categories FROM spikes",
        DAILY_SQL, SPIKE_DAYS_SQL, SPIKES_SQL,
    ),
)
def _(spark, sf):
    return rollups.spike_summary(rules.spend_spikes(ledger(spark, sf)))


# ---------------------------------------------------------------- rule score
def _score(drain: str, dup: str, spike: str) -> str:
    return f"""CASE WHEN {drain} THEN 1.0::DOUBLE WHEN {dup} THEN 0.8::DOUBLE WHEN {spike} THEN 0.65::DOUBLE ELSE 0.0::DOUBLE END AS rule_score,
    CASE WHEN {spike} THEN '{K.REASON_SPIKE}' WHEN {dup} THEN '{K.REASON_DUPLICATE}' WHEN {drain} THEN '{K.REASON_DRAIN}' ELSE '' END AS rule_reason"""


RULE_CTES = [NEAREST_SQL, PAIRS_SQL, DRAIN_ROWS_SQL, DRAIN_VALUES_SQL, DUPS_SQL, DAILY_SQL, SPIKE_DAYS_SQL, SPIKES_SQL]
FLAGS_SQL = f"""flags AS (SELECT *, {_score('row_id IN (SELECT row_id FROM drained)', 'row_id IN (SELECT row_id FROM dups)', 'row_id IN (SELECT row_id FROM spikes)')} FROM ledger)"""
STEP_FLAGS_SQL = f"""step_drained AS (SELECT DISTINCT l.step FROM ledger l JOIN drained_values d ON l.step = d.step AND l.nameOrig = d.nameOrig AND round_even(l.amount, 2) = amt),
flags AS (SELECT *, {_score('step IN (SELECT step FROM step_drained)', 'step IN (SELECT step FROM dups)', 'step IN (SELECT step FROM spikes)')} FROM ledger)"""


@query("rule_risk_flags", over_ledger("SELECT row_id, step, rule_score, rule_reason FROM flags", *RULE_CTES, FLAGS_SQL))
def _(spark, sf):
    return rules.rule_risk_flags(ledger(spark, sf)).select("row_id", "step", "rule_score", "rule_reason")


@query("rule_risk_flags_by_step", over_ledger("SELECT row_id, step, rule_score, rule_reason FROM flags", *RULE_CTES, STEP_FLAGS_SQL))
def _(spark, sf):
    return rules.rule_risk_flags(ledger(spark, sf), match_on="step").select("row_id", "step", "rule_score", "rule_reason")


# ---------------------------------------------------------------- risk scan, rules only
def _scored(spark, sf):
    return rules.blend(rules.rule_risk_flags(ledger(spark, sf)))


SCORED_SQL = "scored AS (SELECT *, round_even(rule_score, 3) AS risk_score, 0.0::DOUBLE AS model_score, 0.0::DOUBLE AS isolation_score, rule_reason AS reason FROM flags)"
SCORED_CTES = [*RULE_CTES, FLAGS_SQL, SCORED_SQL]
SHOW = ["row_id", "date", "merchant", "amount", "category", "type", "risk_score", "rule_score", "model_score", "reason", "fraud_archetype"]


@query("risk_scores", over_ledger("SELECT row_id, risk_score, rule_score, model_score, isolation_score, rule_reason, reason FROM scored", *SCORED_CTES))
def _(spark, sf):
    return _scored(spark, sf).select("row_id", "risk_score", "rule_score", "model_score", "isolation_score", "rule_reason", "reason")


@query(
    "top_risk",
    over_ledger(f"SELECT {', '.join(SHOW)} FROM scored WHERE risk_score >= 0.7 ORDER BY risk_score DESC, row_id LIMIT 15", *SCORED_CTES),
)
def _(spark, sf):
    return rules.top_risk(_scored(spark, sf), 15, SHOW)


@query(
    "top_risk_focal_checking",
    over_ledger(
        f"SELECT {', '.join(SHOW)} FROM scored WHERE risk_score >= 0.6 AND is_focal_user AND account_type = 'checking' ORDER BY risk_score DESC, row_id LIMIT 50",
        *SCORED_CTES,
    ),
)
def _(spark, sf):
    return rules.top_risk(_scored(spark, sf), 50, SHOW, threshold=0.6, focal_only=True, account_type="checking")


@query(
    "flagged_count",
    over_ledger("SELECT account_type, count(*) AS flagged FROM scored WHERE risk_score >= 0.6 GROUP BY 1", *SCORED_CTES),
)
def _(spark, sf):
    return rules.flagged(_scored(spark, sf), 0.6).groupBy("account_type").agg(F.count("*").alias("flagged"))


@query(
    "risk_summary",
    over_ledger(
        f"SELECT count(*) FILTER (risk_score >= 0.6) AS flagged, count(*) AS total, {rnd('100.0::DOUBLE * count(*) FILTER (risk_score >= 0.6) / count(*)', 1)} AS pct FROM scored",
        *SCORED_CTES,
    ),
)
def _(spark, sf):
    return rules.risk_summary(_scored(spark, sf), 0.6)


@query(
    "score_join",
    over_ledger("SELECT l.row_id, l.date, l.amount, s.risk_score FROM ledger l JOIN scored s USING (row_id) WHERE s.risk_score >= 0.65", *SCORED_CTES),
)
def _(spark, sf):
    scores = _scored(spark, sf).select("row_id", "risk_score").where(F.col("risk_score") >= 0.65)
    return ledger(spark, sf).select("row_id", "date", "amount").join(scores, "row_id")


@query(
    "top_tips",
    over_ledger(
        """SELECT persona_id, CASE WHEN savings_rate < 0.20 THEN 'raise_savings' WHEN subscription_ratio > 0.05 THEN 'trim_subscriptions' ELSE 'keep_it_up' END AS tip,
        savings_rate, subscription_ratio, (SELECT least(count(*), 5) FROM scored WHERE risk_score >= 0.7) AS flagged, forecast_expenses
        FROM health JOIN forecast USING (persona_id)""",
        *SCORED_CTES, FOCAL, HEALTH_SQL, FORECAST_SQL,
    ),
)
def _(spark, sf):
    focal = filters.focal(ledger(spark, sf))
    shown = rules.top_risk(_scored(spark, sf), 5, ["row_id", "risk_score"]).agg(F.count("*")).scalar()
    return rollups.tips(rollups.financial_health(focal.where("is_focal_user"), BY), rollups.forecast_next_month(focal, BY), shown, BY)


# ---------------------------------------------------------------- features
FEATURES_SQL = f"""regions AS (SELECT * FROM (VALUES {REGION_VALUES}) AS t(region_id, city, state, lat, lon)),
features AS (SELECT row_id, amount, ln(1.0::DOUBLE + amount) AS log_amount,
  amount / (oldbalanceOrg + 1.0::DOUBLE) AS amount_ratio_orig,
  CASE WHEN oldbalanceDest > 0 THEN amount / (oldbalanceDest + 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS amount_ratio_dest,
  newbalanceOrig / (oldbalanceOrg + 1.0::DOUBLE) AS balance_after_ratio,
  ln(1.0::DOUBLE + greatest(oldbalanceOrg, 0)) AS log_oldbalance_orig, ln(1.0::DOUBLE + greatest(oldbalanceDest, 0)) AS log_oldbalance_dest,
  CAST(is_focal_user AS DOUBLE) AS is_focal,
  CAST(row_number() OVER o - 1 AS DOUBLE) AS count_prior_orig,
  coalesce(sum(amount) OVER (PARTITION BY nameOrig ORDER BY step, l.row_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS sum_amount_prev7_orig,
  CAST(coalesce(step - lag(step) OVER o, 999) AS DOUBLE) AS steps_since_prev_orig,
  CAST(row_number() OVER d - 1 AS DOUBLE) AS count_prior_dest,
  coalesce(sum(amount) OVER (PARTITION BY nameDest ORDER BY step, l.row_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS sum_amount_prev7_dest,
  CAST(step % 24 AS DOUBLE) AS hour_of_day,
  amount / (coalesce(sum(amount) OVER c / nullif(count(*) OVER c, 0), amount) + 1.0::DOUBLE) AS amount_vs_category_mean,
  coalesce(2 * {K.EARTH_RADIUS_MILES}::DOUBLE * asin(sqrt(pow(sin((radians(h.lat) - radians(t.lat)) / 2), 2)
    + cos(radians(t.lat)) * cos(radians(h.lat)) * pow(sin((radians(h.lon) - radians(t.lon)) / 2), 2))), 0.0::DOUBLE) AS region_distance_miles,
  CAST(transaction_region <> home_region AS DOUBLE) AS is_out_of_home_region,
  CAST(row_number() OVER (PARTITION BY nameOrig, merchant ORDER BY step, l.row_id) = 1 AS DOUBLE) AS is_new_merchant,
  CAST(row_number() OVER (PARTITION BY nameOrig, nameDest ORDER BY step, l.row_id) = 1 AS DOUBLE) AS is_new_payee,
  {', '.join(f"CAST(account_type = '{a}' AS DOUBLE) AS account_{a}" for a in K.ACCOUNT_TYPES)},
  CAST(isodow(CAST(date AS DATE)) >= 6 AS DOUBLE) AS is_weekend,
  {', '.join(f"CAST(type = '{a}' AS DOUBLE) AS type_{a}" for a in K.TYPES)}
  FROM ledger l LEFT JOIN regions t ON t.region_id = transaction_region LEFT JOIN regions h ON h.region_id = home_region
  WINDOW o AS (PARTITION BY nameOrig ORDER BY step, l.row_id), d AS (PARTITION BY nameDest ORDER BY step, l.row_id),
    c AS (PARTITION BY category ORDER BY step, l.row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("features", over_ledger("SELECT row_id, " + ", ".join(f"{rnd(f, 6)} AS {f}" for f in FEATURES) + " FROM features", FEATURES_SQL))
def _(spark, sf):
    built = build_features(ledger(spark, sf), staged=True)
    return built.select("row_id", *[C.rnd(f, 6).alias(f) for f in FEATURES])


@query(
    "region_distances",
    over_ledger(
        f"SELECT transaction_region, home_region, count(*) AS n, {rnd('avg(region_distance_miles)', 4)} AS miles FROM features JOIN ledger USING (row_id) GROUP BY 1, 2",
        FEATURES_SQL,
    ),
)
def _(spark, sf):
    return (
        C.with_region_distance(ledger(spark, sf).select("transaction_region", "home_region"))
        .groupBy("transaction_region", "home_region")
        .agg(F.count("*").alias("n"), C.rnd(F.avg("region_distance_miles"), 4).alias("miles"))
    )


@query(
    "dimension_lookups",
    over_ledger(
        """SELECT category, category_group, coalesce(s, 'background') AS archetype, count(*) AS n
        FROM ledger LEFT JOIN (SELECT persona_id AS p, arg_min(persona_archetype, row_id) AS s FROM ledger WHERE is_focal_user GROUP BY 1) ON p = persona_id GROUP BY 1, 2, 3"""
    ),
)
def _(spark, sf):
    whole = ledger(spark, sf).select("persona_id", "category")
    manifest = rollups.persona_manifest(ledger(spark, sf)).select("persona_id", "archetype")
    return (
        whole.groupBy("persona_id", "category")
        .agg(F.count("*").alias("n"))
        .join(manifest, "persona_id", "left")
        .groupBy("category", C.category_group(F.col("category")).alias("category_group"), F.coalesce("archetype", F.lit("background")).alias("archetype"))
        .agg(F.sum("n").alias("n"))
    )


