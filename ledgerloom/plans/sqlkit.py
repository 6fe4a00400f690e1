"""Pieces of DuckDB SQL the oracle queries share.

They restate the semantics independently of the Spark code: plain SQL over the
driver's tables, with none of the splitting the Spark side needs at scale.
"""

from __future__ import annotations

from ledgerloom import constants as K


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def rnd(expr: str, digits: int) -> str:
    """Half-even rounding; adding zero turns -0.0 into 0.0."""
    return f"(round_even(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


_SUBS = " ".join(f"WHEN '{c}' THEN {sql_list(v)}[1 + l_suppkey % {len(v)}]" for c, v in K.SUBCATEGORIES.items())
GROUP_CASE = "CASE category " + " ".join(f"WHEN '{c}' THEN '{g}'" for c, g in K.CATEGORY_GROUP.items()) + " ELSE 'other' END"
_REGIONS = sql_list(K.region_id(i) for i in range(36))
REGION_VALUES = ", ".join(
    f"('{K.region_id(i)}', '{c}', '{s}', CAST({la} AS DOUBLE), CAST({lo} AS DOUBLE))" for i, (c, s, la, lo) in enumerate(K.REGIONS)
)

EXPENSE = (
    "(type NOT IN ('SALARY', 'CASH_IN') AND NOT (type = 'TRANSFER' AND category IN ('savings', 'credit')))"
)
INCOME = "(type IN ('SALARY', 'CASH_IN') AND account_type = 'checking')"
CREDIT = "(type IN ('SALARY', 'CASH_IN'))"
SAVINGS = "(type = 'TRANSFER' AND category = 'savings')"
SPENDING = in_list(K.SPENDING_CATEGORIES)

_LEDGER = f"""
acc AS (SELECT greatest(1, count(*) // 30) AS n FROM customer),
l0 AS (
  SELECT l.*, o.o_custkey % (SELECT n FROM acc) AS k, (SELECT n FROM acc) AS n, p.p_size,
    datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 24
      + (l_partkey * 7 + l_linenumber * 5 + l_suppkey) % 24 AS step,
    {sql_list(K.TYPES)}[1 + (l_partkey + l_linenumber) % 8] AS type,
    l_quantity * 40.0::DOUBLE AS amount
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN part p ON l_partkey = p_partkey
),
l1 AS (
  SELECT *, 'U' || k AS persona_id,
    CASE WHEN k % 5 <> 0 THEN 'background' WHEN (l_partkey + l_suppkey) % 8 = 0 THEN 'savings'
         WHEN (l_partkey + l_suppkey) % 8 = 1 THEN 'credit' ELSE 'checking' END AS account_type,
    CASE WHEN type = 'SALARY' THEN 'income'
         WHEN type = 'CASH_IN' THEN CASE WHEN l_partkey % 3 = 0 THEN 'refund' ELSE 'income' END
         WHEN type = 'CASH_OUT' THEN 'transfer'
         WHEN type = 'SUBSCRIPTION' THEN 'subscriptions'
         WHEN type = 'TRANSFER' THEN ['savings', 'credit', 'transfer', 'housing'][1 + l_partkey % 4]
         ELSE {sql_list(K.SPENDING_CATEGORIES[:7])}[1 + p_size % 7] END AS category,
    amount * CAST(1 + l_orderkey % 5 AS DOUBLE) AS oldbalanceOrg,
    {_REGIONS}[1 + k % 36] AS home_region,
    CAST((l_orderkey * 31 + l_linenumber) % 97 = 0 AS INTEGER) AS isFraud,
    CAST((l_orderkey * 13 + l_linenumber * 7) % 89 = 0 AS INTEGER) AS is_anomaly,
    strftime(TIMESTAMP '1995-01-01' + to_hours(step), '%Y-%m-%dT%H:%M') AS datetime
  FROM l0
),
stored AS (
  SELECT row_number() OVER (ORDER BY step, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
      l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS row_id,
    step, type, amount,
    persona_id || CASE account_type WHEN 'savings' THEN '_Sav' WHEN 'credit' THEN '_Cred' ELSE '' END AS nameOrig,
    oldbalanceOrg,
    CASE WHEN type IN ('SALARY', 'CASH_IN') THEN oldbalanceOrg + amount ELSE oldbalanceOrg - amount END AS newbalanceOrig,
    CASE WHEN type = 'TRANSFER' THEN 'U' || ((l_suppkey * 13 + l_partkey) % n) ELSE 'M' || l_suppkey END AS nameDest,
    CASE WHEN type = 'TRANSFER' THEN l_quantity * CAST(l_suppkey % 7 AS DOUBLE) * 10.0::DOUBLE ELSE 0.0::DOUBLE END AS oldbalanceDest,
    CASE WHEN type = 'TRANSFER' THEN l_quantity * CAST(l_suppkey % 7 AS DOUBLE) * 10.0::DOUBLE + amount ELSE 0.0::DOUBLE END AS newbalanceDest,
    'M' || l_suppkey AS merchant, category, datetime, substr(datetime, 1, 10) AS date,
    (k % 5 = 0 AND account_type = 'checking') AS is_focal_user,
    isFraud, CAST(amount > 200000 AS INTEGER) AS isFlaggedFraud, is_anomaly,
    CASE WHEN is_anomaly = 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 'duplicate_charge' ELSE 'spend_spike' END ELSE '' END AS anomaly_type,
    persona_id,
    CASE WHEN k % 5 = 0 THEN {sql_list(K.PERSONA_ARCHETYPES)}[1 + k % 6] ELSE 'background' END AS persona_archetype,
    account_type,
    CASE WHEN l_partkey % 97 = 0 THEN 'R99_unknown'
         WHEN (l_partkey * 3 + l_suppkey) % 10 = 0 THEN {_REGIONS}[1 + (k + 1 + l_partkey % 35) % 36]
         ELSE home_region END AS merchant_region,
    CASE WHEN l_partkey % 97 = 0 THEN 'R99_unknown'
         WHEN (l_partkey * 3 + l_suppkey) % 10 = 0 THEN {_REGIONS}[1 + (k + 1 + l_partkey % 35) % 36]
         ELSE home_region END AS transaction_region,
    home_region,
    {GROUP_CASE} AS category_group,
    CASE category {_SUBS} END AS subcategory,
    CASE WHEN isFraud = 1 THEN {sql_list(K.FRAUD_ARCHETYPES)}[1 + (l_orderkey + l_partkey) % 12]
         WHEN (l_orderkey * 7 + l_partkey) % 211 = 0 AND is_anomaly = 0 THEN {sql_list(K.HARD_NEGATIVES)}[1 + l_partkey % 3]
         ELSE '' END AS fraud_archetype,
    step + CASE WHEN isFraud = 1 AND l_partkey % 10 = 0 THEN 24 + l_orderkey % 696 ELSE 0 END AS label_reported_at_step,
    CAST(substr(datetime, 1, 4) AS INTEGER) AS simulation_year,
    CAST((l_partkey * 17 + l_orderkey * 3) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS score,
    CAST((l_partkey * 7 + l_orderkey * 11) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS score_alt
  FROM l1
),
ledger AS (SELECT * EXCLUDE (score, score_alt) FROM stored),
scores AS (
  SELECT row_id, step, isFraud AS y, score, score_alt, fraud_archetype AS archetype, persona_archetype AS cohort FROM stored
)
"""


def over_ledger(body: str, *ctes: str) -> str:
    """A query over the CTEs `ledger` and `scores`, with further CTEs in between."""
    return "WITH " + ",\n".join([_LEDGER.strip(), *ctes]) + "\n" + body


def with_ctes(body: str, *ctes: str) -> str:
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
