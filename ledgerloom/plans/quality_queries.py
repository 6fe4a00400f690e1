"""Balances, data-quality checks and pattern detectors over the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions import columns as C
from ledgerloom.operators import balances, quality
from ledgerloom.operators import detectors as D
from ledgerloom.plans.registry import query
from ledgerloom.plans.rule_queries import NEAREST_SQL
from ledgerloom.plans.sqlkit import GROUP_CASE, in_list, over_ledger, rnd, sql_list
from ledgerloom.sources.ledger import LEDGER, ledger

# ---------------------------------------------------------------- balances
EVENTS_SQL = """events2 AS (SELECT nameOrig AS account, step, 0 AS side, row_id, CASE WHEN type IN ('SALARY', 'CASH_IN') THEN amount ELSE -amount END AS delta FROM ledger
  UNION ALL SELECT nameDest, step, 1, row_id, amount FROM ledger WHERE type = 'TRANSFER' AND nameDest IN (SELECT nameOrig FROM ledger))"""
BALANCE_SQL = """plain AS (SELECT *, 1000.0::DOUBLE + sum(delta) OVER (PARTITION BY account ORDER BY step, side, row_id ROWS UNBOUNDED PRECEDING) AS balance FROM events2)"""


@query("account_events", over_ledger("SELECT * FROM events2", EVENTS_SQL))
def _(spark, sf):
    return balances.account_events(ledger(spark, sf))


@query(
    "running_balances",
    over_ledger(
        """SELECT account, step, side, row_id, delta, balance, CASE WHEN account LIKE '%\\_Cred' ESCAPE '\\'
        THEN balance - greatest(max(balance) OVER w, 1000.0::DOUBLE, 0) ELSE balance - least(min(balance) OVER w, 0) END AS clamped
        FROM plain WINDOW w AS (PARTITION BY account ORDER BY step, side, row_id ROWS UNBOUNDED PRECEDING)""",
        EVENTS_SQL, BALANCE_SQL,
    ),
)
def _(spark, sf):
    return balances.running_balances(ledger(spark, sf), 1000.0)


@query(
    "days_since_payday",
    over_ledger(
        """SELECT nameOrig, CAST(day AS VARCHAR) AS day, CAST(least(coalesce(datediff('day', max(CASE WHEN paid THEN day END) OVER (PARTITION BY nameOrig ORDER BY day), day), 6), 6) AS INTEGER) AS days_since_payday
        FROM (SELECT nameOrig, CAST(date AS DATE) AS day, bool_or(type = 'SALARY') AS paid FROM ledger GROUP BY 1, 2)"""
    ),
)
def _(spark, sf):
    return balances.days_since_payday(ledger(spark, sf))


@query(
    "payday_calendar",
    over_ledger(
        """SELECT persona_id, date, CASE k % 4 WHEN 0 THEN d = dom WHEN 1 THEN d = dom OR d = least(28, dom + 14) WHEN 2 THEN isodow(dt) - 1 = k % 7
          ELSE (((datediff('day', DATE '1995-01-01', dt) - k % 14) % 14) + 14) % 14 = 0 END AS payday
        FROM (SELECT DISTINCT persona_id, date, CAST(date AS DATE) AS dt, day(CAST(date AS DATE)) AS d, CAST(substr(persona_id, 2) AS BIGINT) AS k, 1 + CAST(substr(persona_id, 2) AS BIGINT) % 28 AS dom
          FROM ledger WHERE type = 'SALARY')"""
    ),
)
def _(spark, sf):
    k = F.substring("persona_id", 2, 20).cast("long")
    day = F.to_date("date")
    cadence = F.element_at(F.array(*[F.lit(c) for c in ("monthly", "semimonthly", "weekly", "biweekly")]), (k % 4 + 1).cast("int"))
    paid = C.is_payday(cadence, F.dayofmonth(day), 1 + k % 28, F.weekday(day), k % 7, F.datediff(day, F.lit("1995-01-01")), k % 14)
    return ledger(spark, sf).where(F.col("type") == "SALARY").select("persona_id", "date").distinct().select("persona_id", "date", paid.alias("payday"))


SEASON_SQL = "CASE category " + " ".join(f"WHEN '{c}' THEN [{', '.join(f'{v}::DOUBLE' for v in vs)}][m]" for c, vs in K.SEASONAL.items()) + " ELSE 1.0::DOUBLE END"


@query(
    "seasonal_baseline",
    over_ledger(
        f"""SELECT category, m AS month, (m = 12 OR (m = 11 AND d >= 15)) AS is_holiday, count(*) AS n, {rnd('sum(amount / mult)', 2)} AS deseasonalised
        FROM (SELECT *, {SEASON_SQL} AS mult FROM (SELECT *, CAST(substr(date, 6, 2) AS INTEGER) AS m, CAST(substr(date, 9, 2) AS INTEGER) AS d FROM ledger)) GROUP BY 1, 2, 3"""
    ),
)
def _(spark, sf):
    month, day = F.substring("date", 6, 2).cast("int"), F.substring("date", 9, 2).cast("int")
    level = F.col("amount") / C.seasonal_multiplier(F.col("category"), month)
    return (
        ledger(spark, sf)
        .groupBy("category", month.alias("month"), C.is_holiday(month, day).alias("is_holiday"))
        .agg(F.count("*").alias("n"), C.rnd(F.sum(level), 2).alias("deseasonalised"))
    )


# ---------------------------------------------------------------- quality
@query(
    "balance_arithmetic",
    over_ledger("SELECT count(*) AS violations FROM ledger WHERE abs(newbalanceOrig - (oldbalanceOrg + CASE WHEN type IN ('SALARY', 'CASH_IN') THEN amount ELSE -amount END)) > 0.02"),
)
def _(spark, sf):
    return quality.arithmetic_violations(ledger(spark, sf)).agg(F.count("*").alias("violations"))


@query(
    "balance_chain_breaks",
    over_ledger(
        "SELECT row_id, nameOrig, oldbalanceOrg, previous FROM (SELECT *, lag(newbalanceOrig) OVER (PARTITION BY nameOrig ORDER BY step, row_id) AS previous FROM ledger) WHERE abs(oldbalanceOrg - previous) > 0.02"
    ),
)
def _(spark, sf):
    return quality.chain_breaks(ledger(spark, sf))


@query("negative_balances", over_ledger("SELECT row_id, nameOrig, newbalanceOrig FROM ledger WHERE newbalanceOrig < -0.02 AND account_type <> 'credit'"))
def _(spark, sf):
    return quality.negative_balances(ledger(spark, sf))


@query("fraud_rate_band", over_ledger(f"SELECT {rnd('avg(CAST(isFraud AS DOUBLE))', 6)} AS fraud_rate, avg(CAST(isFraud AS DOUBLE)) BETWEEN 0.0005 AND 0.05 AS in_band FROM ledger"))
def _(spark, sf):
    return quality.fraud_rate(ledger(spark, sf))


@query(
    "missing_archetypes",
    over_ledger(f"SELECT a AS archetype FROM (SELECT unnest({sql_list([*K.FRAUD_ARCHETYPES, *K.HARD_NEGATIVES])}) AS a) WHERE a NOT IN (SELECT fraud_archetype FROM ledger WHERE isFraud = 1 OR is_anomaly = 1)"),
)
def _(spark, sf):
    return quality.missing_archetypes(ledger(spark, sf), [*K.FRAUD_ARCHETYPES, *K.HARD_NEGATIVES])


@query(
    "hard_negative_labels",
    over_ledger(f"SELECT fraud_archetype, count(*) AS n, count(*) FILTER (isFraud <> 0 OR is_anomaly <> 0) AS labelled FROM ledger WHERE fraud_archetype IN {in_list(K.HARD_NEGATIVES)} GROUP BY 1"),
)
def _(spark, sf):
    return quality.labelled_hard_negatives(ledger(spark, sf))


HOLIDAY = "(month(day) = 12 OR (month(day) = 11 AND day(day) >= 15))"


@query(
    "holiday_lift",
    over_ledger(
        f"""SELECT is_holiday, days, coalesce(transactions, 0) AS transactions, {rnd('coalesce(transactions, 0) / CAST(days AS DOUBLE)', 6)} AS per_day FROM
        (SELECT {HOLIDAY} AS is_holiday, count(*) AS days FROM (SELECT unnest(generate_series((SELECT min(CAST(date AS DATE)) FROM ledger)::TIMESTAMP, (SELECT max(CAST(date AS DATE)) FROM ledger)::TIMESTAMP, INTERVAL 1 DAY)) AS day) GROUP BY 1)
        LEFT JOIN (SELECT {HOLIDAY} AS is_holiday, count(*) AS transactions FROM (SELECT CAST(date AS DATE) AS day FROM ledger WHERE is_focal_user AND category = 'shopping') GROUP BY 1) USING (is_holiday)"""
    ),
)
def _(spark, sf):
    return quality.holiday_lift(ledger(spark, sf))


@query("category_group_check", over_ledger(f"SELECT category, count(*) FILTER (category_group <> {GROUP_CASE}) AS mismatches, count(*) AS n FROM ledger GROUP BY 1"))
def _(spark, sf):
    return quality.group_mismatches(ledger(spark, sf))


@query(
    "label_lag",
    over_ledger("SELECT count(*) FILTER (label_reported_at_step < step) AS negative, count(*) FILTER (label_reported_at_step > step) AS lagged, max(label_reported_at_step - step) AS max_lag FROM ledger WHERE isFraud = 1"),
)
def _(spark, sf):
    return quality.label_lag(ledger(spark, sf))


@query(
    "pay_drift",
    over_ledger(
        f"SELECT persona_id, {rnd('b.v / a.v', 6)} AS ratio FROM (SELECT persona_id, avg(amount) AS v FROM ledger WHERE type = 'SALARY' AND simulation_year = 1996 GROUP BY 1) a JOIN (SELECT persona_id, avg(amount) AS v FROM ledger WHERE type = 'SALARY' AND simulation_year = 2000 GROUP BY 1) b USING (persona_id)"
    ),
)
def _(spark, sf):
    return quality.pay_drift(ledger(spark, sf), 1996, 2000)


@query(
    "savings_growth",
    over_ledger("SELECT nameOrig, arg_max(newbalanceOrig, (step, row_id)) - arg_min(oldbalanceOrg, (step, row_id)) AS growth FROM ledger WHERE suffix(nameOrig, '_Sav') GROUP BY 1"),
)
def _(spark, sf):
    return quality.account_growth(ledger(spark, sf))


@query(
    "schema_report",
    over_ledger(
        "SELECT count(*) FILTER (isFraud NOT IN (0, 1)) AS \"isFraud_not_binary\", count(*) FILTER (isFlaggedFraud NOT IN (0, 1)) AS \"isFlaggedFraud_not_binary\", count(*) FILTER (is_anomaly NOT IN (0, 1)) AS is_anomaly_not_binary, count(*) FILTER (isFraud = 1 AND coalesce(fraud_archetype, '') = '') AS fraud_without_archetype, count(*) FILTER (amount <= 0) AS non_positive_amounts FROM ledger"
    ),
)
def _(spark, sf):
    return quality.schema_report(ledger(spark, sf))


@query(
    "account_structure",
    over_ledger(
        "SELECT account_type, count(*) AS n, count(*) FILTER (CASE account_type WHEN 'credit' THEN NOT suffix(nameOrig, '_Cred') WHEN 'savings' THEN NOT suffix(nameOrig, '_Sav') ELSE suffix(nameOrig, '_Cred') OR suffix(nameOrig, '_Sav') END) AS misnamed FROM ledger GROUP BY 1"
    ),
)
def _(spark, sf):
    return quality.account_structure(ledger(spark, sf))


@query(
    "merchant_concentration",
    over_ledger(
        f"SELECT CAST(sum(n) AS BIGINT) AS top_rows, (SELECT count(*) FROM ledger) AS n_rows, {rnd('sum(n) / (SELECT count(*) FROM ledger)', 6)} AS share FROM (SELECT merchant, count(*) AS n FROM ledger GROUP BY 1 ORDER BY n DESC, merchant LIMIT 10)"
    ),
)
def _(spark, sf):
    return quality.merchant_concentration(ledger(spark, sf))


@query(
    "region_signal",
    over_ledger("SELECT count(*) FILTER (transaction_region <> home_region) AS away, count(*) FILTER (merchant_region IS NULL) AS null_merchant_region, count(*) FILTER (home_region IS NULL) AS null_home_region FROM ledger"),
)
def _(spark, sf):
    return quality.region_signal(ledger(spark, sf))


def _row_text() -> str:
    parts = []
    for f in sorted(LEDGER.fields, key=lambda f: f.name):
        value = f"CAST({f.name} AS DECIMAL(38,6))" if f.dataType.typeName() == "double" else f.name
        parts.append(f"coalesce(CAST({value} AS VARCHAR), '\\N') || chr(31)")
    return " || ".join(parts)


@query(
    "content_fingerprint",
    over_ledger(
        f"SELECT CAST(sum(CAST(CAST('0x' || substr(md5({_row_text()}), 1, 15) AS BIGINT) AS DECIMAL(38,0))) AS VARCHAR) AS digest, count(*) AS n FROM ledger"
    ),
)
def _(spark, sf):
    return quality.fingerprint(ledger(spark, sf)).select("digest", "n")


# ---------------------------------------------------------------- detectors
def _first(other: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nameOrig, {other} ORDER BY step, row_id) AS rn FROM ledger) WHERE rn = 1)"


@query(
    "card_testing",
    over_ledger(
        """SELECT row_id, nameOrig, step, amount, max(burst_step) AS burst_step, arg_max(small_charges, burst_step) AS small_charges
        FROM (SELECT l.*, b.step AS burst_step, small_charges FROM ledger l JOIN
          (SELECT nameOrig, step, count(*) AS small_charges FROM fm WHERE type = 'SHOP' AND amount < 900 GROUP BY 1, 2 HAVING count(*) >= 1) b
          ON l.nameOrig = b.nameOrig AND l.step - b.step BETWEEN 1 AND 48 WHERE l.type = 'SHOP' AND l.amount >= 1200) GROUP BY row_id, nameOrig, step, amount""",
        _first("merchant", "fm"),
    ),
)
def _(spark, sf):
    return D.card_testing(ledger(spark, sf), small=900, large=1200, charges=1, within=48)


@query(
    "slow_drain",
    over_ledger(
        """SELECT l.nameOrig, l.nameDest, first_step, count(*) AS transfers, sum(amount) AS total FROM ledger l
        JOIN (SELECT nameOrig, nameDest, min(step) AS first_step FROM ledger GROUP BY 1, 2) f USING (nameOrig, nameDest)
        WHERE type = 'TRANSFER' AND amount BETWEEN 40 AND 1600 AND step <= first_step + 9600 GROUP BY 1, 2, 3 HAVING count(*) >= 3"""
    ),
)
def _(spark, sf):
    return D.slow_drain(ledger(spark, sf), high=1600, transfers=3, days=400)


REGION_FIRST = [_first("transaction_region", "fr0"), "fr AS (SELECT * FROM fr0 WHERE transaction_region <> home_region)"]


@query(
    "region_then_payee",
    over_ledger(
        "SELECT p.row_id, p.nameOrig, p.nameDest, p.step, p.amount, max(r.step) AS region_step, count(*) AS new_regions FROM fp p JOIN fr r ON p.nameOrig = r.nameOrig AND p.step BETWEEN r.step AND r.step + 240 WHERE p.type = 'TRANSFER' AND p.amount >= 900 GROUP BY 1, 2, 3, 4, 5",
        *REGION_FIRST, _first("nameDest", "fp"),
    ),
)
def _(spark, sf):
    return D.region_then_payee(ledger(spark, sf), hours=240)


@query(
    "subscription_creep",
    over_ledger(
        "SELECT row_id, nameOrig, merchant, step, new_merchants FROM (SELECT *, count(*) OVER (PARTITION BY nameOrig ORDER BY step RANGE BETWEEN 192 PRECEDING AND CURRENT ROW) AS new_merchants FROM fm WHERE type = 'SUBSCRIPTION') WHERE new_merchants >= 3",
        _first("merchant", "fm"),
    ),
)
def _(spark, sf):
    return D.subscription_creep(ledger(spark, sf))


@query(
    "refund_loop",
    over_ledger(
        """SELECT row_id, nameOrig, merchant, amount, first_step, step FROM (SELECT *, lag(type) OVER w AS t1, lag(type, 2) OVER w AS t2, lag(step, 2) OVER w AS first_step
        FROM ledger WHERE type = 'SHOP' OR (type = 'CASH_IN' AND category = 'refund') WINDOW w AS (PARTITION BY nameOrig, merchant ORDER BY step, row_id))
        WHERE type = 'SHOP' AND t1 = 'CASH_IN' AND t2 = 'SHOP' AND step - first_step <= 2880"""
    ),
)
def _(spark, sf):
    return D.refund_loop(ledger(spark, sf), days=120, same_amount=False)


def _pairs(ratio: float) -> str:
    return f"""pairs AS (SELECT row_id AS transfer_id, step AS transfer_step, amount AS transfer_amount, nameOrig, cashout_id FROM paired
  WHERE amount >= 500 AND oldbalanceOrg > 0 AND newbalanceOrig <= {ratio}::DOUBLE * oldbalanceOrg AND cashout_step - step <= 6 AND cashout_amount >= 0.9::DOUBLE * amount)"""


@query(
    "account_takeover",
    over_ledger(
        "SELECT transfer_id, p.nameOrig, transfer_step, transfer_amount, cashout_id, count(*) AS new_regions FROM pairs p JOIN fr ON fr.nameOrig = p.nameOrig AND fr.step BETWEEN transfer_step - 36000 AND transfer_step GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 2",
        NEAREST_SQL, _pairs(0.25), *REGION_FIRST,
    ),
)
def _(spark, sf):
    return D.takeover(ledger(spark, sf), days=1500)


@query(
    "bust_out",
    over_ledger(
        """SELECT nameOrig, transfer_step, transfer_id, transfer_amount, cashout_id, opened_step FROM
        (SELECT *, row_number() OVER (PARTITION BY nameOrig ORDER BY transfer_step, transfer_id) AS rn FROM pairs) JOIN (SELECT nameOrig, min(step) AS opened_step FROM ledger GROUP BY 1) USING (nameOrig)
        WHERE rn = 1 AND transfer_step - opened_step >= 0.3::DOUBLE * (SELECT max(step) - min(step) FROM ledger)""",
        NEAREST_SQL, _pairs(0.1),
    ),
)
def _(spark, sf):
    return D.bust_out(ledger(spark, sf), age=0.3)


@query(
    "travel_stays",
    over_ledger(
        "SELECT row_id, nameOrig, transaction_region, step, n AS rows_in_region FROM (SELECT *, count(*) OVER (PARTITION BY nameOrig, transaction_region ORDER BY step RANGE BETWEEN 240 PRECEDING AND CURRENT ROW) AS n FROM ledger WHERE transaction_region <> home_region) WHERE n >= 2"
    ),
)
def _(spark, sf):
    return D.trips(ledger(spark, sf), rows=2, days=10)


@query(
    "errand_bursts",
    over_ledger(
        """SELECT nameOrig, step, charges FROM (SELECT nameOrig, step, CAST(sum(sum(1)) OVER w AS BIGINT) AS charges, max(max(CAST(category = 'groceries' AS INT))) OVER w AS g,
        max(max(CAST(category = 'transport' AS INT))) OVER w AS t, max(max(CAST(category = 'dining' AS INT))) OVER w AS d FROM ledger WHERE category IN ('groceries', 'transport', 'dining')
        GROUP BY nameOrig, step WINDOW w AS (PARTITION BY nameOrig ORDER BY step RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)) WHERE g + t + d = 3"""
    ),
)
def _(spark, sf):
    return D.errand_bursts(ledger(spark, sf), hours=24)


@query(
    "life_events",
    over_ledger("SELECT row_id, nameOrig, category, amount FROM ledger WHERE ((type = 'SHOP' AND category = 'shopping') OR (type = 'PAYMENT' AND category IN ('health', 'housing'))) AND amount >= 800"),
)
def _(spark, sf):
    return D.life_events(ledger(spark, sf))
