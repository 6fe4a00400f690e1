"""Usage accounting, text jobs, alerts and request limits in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions import columns as C
from ledgerloom.operators import alerts, rollups, text, usage
from ledgerloom.plans.registry import query
from ledgerloom.plans.rollup_queries import BY, FOCAL_ALL, MONTHS_SQL
from ledgerloom.plans.rule_queries import SCORED_CTES, _scored
from ledgerloom.plans.sqlextra import CALLS, COSTED, PRICES, QUESTIONS
from ledgerloom.plans.sqlkit import over_ledger, rnd, with_ctes
from ledgerloom.sources import derived
from ledgerloom.sources.ledger import ledger
from ledgerloom.sources.tables import table


def _costed(spark, sf):
    return usage.with_cost(derived.calls(spark, sf))


# ---------------------------------------------------------------- usage
TOTALS = f"""count(*) AS calls, count(*) FILTER (kind = 'llm') AS llm_calls, count(*) FILTER (kind <> 'llm') AS narrator_calls, count(*) FILTER (kind = 'llm' AND NOT ok) AS failed_calls,
  CAST(coalesce(sum(input_tokens) FILTER (kind = 'llm'), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens) FILTER (kind = 'llm'), 0) AS BIGINT) AS output_tokens,
  {rnd("coalesce(sum(CAST(round_even(est_cost, 6) AS DECIMAL(18, 6))) FILTER (kind = 'llm'), 0)", 6)} AS est_cost, {rnd('coalesce(avg(latency_ms) FILTER (latency_ms > 0), 0.0)', 1)} AS avg_latency_ms"""


@query("session_totals", with_ctes(f"SELECT session_id, {TOTALS} FROM costed GROUP BY 1", CALLS, PRICES, COSTED))
def _(spark, sf):
    return usage.session_totals(_costed(spark, sf))


@query(
    "usage_counters",
    with_ctes(
        "SELECT session_id, count(*) AS turns, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM calls GROUP BY 1",
        CALLS,
    ),
)
def _(spark, sf):
    return _counters(spark, sf)


def _counters(spark, sf):
    rows = derived.calls(spark, sf).select(
        "session_id", F.lit(1).cast("long").alias("turns"), "input_tokens", "output_tokens", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "ts"
    )
    half = rows.agg(F.max("ts") - F.expr("interval 10 days")).scalar()
    stored = rows.where(F.col("ts") < half).groupBy("session_id").agg(
        *[F.sum(c).alias(c) for c in ("turns", "input_tokens", "output_tokens")], F.max("updated_at").alias("updated_at")
    )
    return usage.usage_counters(stored, rows.where(F.col("ts") >= half))


@query(
    "recent_sessions",
    with_ctes(
        "SELECT session_id, count(*) AS turns, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM calls GROUP BY 1 ORDER BY updated_at DESC, session_id LIMIT 100",
        CALLS,
    ),
)
def _(spark, sf):
    return usage.recent_sessions(_counters(spark, sf).select("session_id", "turns", "updated_at"))


@query("route_totals", with_ctes(f"SELECT route, requests, {rnd('latency_ms', 4)} AS latency_ms FROM (SELECT route, count(*) AS requests, sum(latency_ms) AS latency_ms FROM calls GROUP BY 1)", CALLS))
def _(spark, sf):
    return usage.route_totals(derived.calls(spark, sf)).select("route", "requests", C.rnd("latency_ms", 4).alias("latency_ms"))


@query(
    "latency_gates",
    with_ctes(
        """SELECT route, n AS requests, failures, latency_ms AS p95_ms, (n > 0 AND latency_ms < 200 AND failures = 0) AS passed FROM
        (SELECT *, row_number() OVER (PARTITION BY route ORDER BY latency_ms, event_id) AS rn, count(*) OVER (PARTITION BY route) AS n, count(*) FILTER (NOT ok) OVER (PARTITION BY route) AS failures FROM calls)
        WHERE rn = greatest(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), 1)""",
        CALLS,
    ),
)
def _(spark, sf):
    return usage.latency_gates(derived.calls(spark, sf))


SKETCHED_SQL = "SELECT route, count(*) AS requests, count(*) FILTER (NOT ok) AS failures, true AS within FROM calls GROUP BY 1"


def rank_check(requests, gates):
    """Whether the rank of each sketched quantile is within the stated error of the wanted one."""
    ranked = requests.join(F.broadcast(gates), "route").groupBy("route").agg(
        F.max("requests").alias("requests"), F.max("failures").alias("failures"), F.count("*").alias("n"),
        F.count_if(F.col("latency_ms") <= F.col("p95_ms")).alias("upto"), F.count_if(F.col("latency_ms") < F.col("p95_ms")).alias("below"),
    )
    wanted, slack = 0.95 * F.col("n"), usage.RANK_ERROR * F.col("n") + 1
    return ranked.select("route", "requests", "failures", ((F.col("below") <= wanted + slack) & (F.col("upto") >= wanted - slack)).alias("within"))


@query("sketched_gates", with_ctes(SKETCHED_SQL, CALLS))
def _(spark, sf):
    """Sketches per route and hour, added up per route."""
    requests = derived.calls(spark, sf)
    return rank_check(requests, usage.sketched_gates(usage.latency_sketches(requests, ["route", F.date_trunc("hour", "ts").alias("hour")])))


@query("never_exercised", with_ctes(f"SELECT r AS route FROM (SELECT unnest({K.GATED_ENDPOINTS!r}) AS r) WHERE r NOT IN (SELECT route FROM calls)", CALLS))
def _(spark, sf):
    return usage.never_exercised(derived.calls(spark, sf))


@query("call_costs", with_ctes(f"SELECT event_id, model, input_tokens, output_tokens, {rnd('est_cost', 8)} AS est_cost FROM costed", CALLS, PRICES, COSTED))
def _(spark, sf):
    return _costed(spark, sf).select("event_id", "model", "input_tokens", "output_tokens", C.rnd("est_cost", 8).alias("est_cost"))


@query(
    "cost_projection",
    with_ctes(f"SELECT {rnd('avg(est_cost)', 8)} AS per_question, {rnd('1000.0::DOUBLE * 0.4::DOUBLE * 3.0::DOUBLE * 30.0::DOUBLE * avg(est_cost)', 4)} AS monthly_cost FROM costed", CALLS, PRICES, COSTED),
)
def _(spark, sf):
    return usage.cost_projection(_costed(spark, sf), 1000.0, 0.4, 3.0)


@query("newest_log_entries", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 15")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(15)


@query("json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event_id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS line FROM events")
def _(spark, sf):
    parsed = F.from_json("props", "k long")
    return table(spark, sf, "events").select(
        "event_id", parsed["k"].alias("k"), F.to_json(F.struct("event_id", F.col("event_type").alias("type"))).alias("line")
    )


@query(
    "trailing_request_count",
    "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS hits FROM events",
)
def _(spark, sf):
    return usage.trailing_count(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 21_600).select("event_id", "user_id", "hits")


TURNS = "turns AS (SELECT conv_id AS session_id, turn, role, text, length(text) // 4 AS tokens FROM conversations)"


@query(
    "budget_guard",
    with_ctes(
        """SELECT session_id, turn, tokens, n AS turns_used, t AS tokens_used, CASE WHEN n >= 6 THEN 'turn budget' WHEN t + tokens > 500 THEN 'token budget' ELSE '' END AS refused
        FROM (SELECT *, count(*) OVER w AS n, CAST(coalesce(sum(tokens) OVER w, 0) AS BIGINT) AS t FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        TURNS,
    ),
)
def _(spark, sf):
    return usage.budget_guard(derived.turns(spark, sf), max_turns=6, max_tokens=500)


@query(
    "conversation_costs",
    with_ctes(
        f"""SELECT session_id, input_tokens, output_tokens, {rnd('input_tokens / 1000000.0::DOUBLE * 3.0::DOUBLE + output_tokens / 1000000.0::DOUBLE * 15.0::DOUBLE', 8)} AS est_cost FROM
        (SELECT session_id, CAST(coalesce(sum(tokens) FILTER (role <> 'assistant'), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(tokens) FILTER (role = 'assistant'), 0) AS BIGINT) AS output_tokens FROM turns GROUP BY 1)""",
        TURNS,
    ),
)
def _(spark, sf):
    said = F.col("role") == "assistant"
    sums = derived.turns(spark, sf).groupBy("session_id").agg(
        F.sum(F.when(said, 0).otherwise(F.col("tokens"))).alias("input_tokens"), F.sum(F.when(said, F.col("tokens")).otherwise(0)).alias("output_tokens")
    )
    return usage.with_cost(sums.withColumn("model", F.lit("standard"))).select("session_id", "input_tokens", "output_tokens", C.rnd("est_cost", 8).alias("est_cost"))


# ---------------------------------------------------------------- text
def _route_sql(column: str) -> str:
    scores = [" + ".join(f"CASE WHEN contains(q, '{w}') THEN {len(w)} ELSE 0 END" for w in words) for _, words in K.ROUTES]
    names = [n for n, _ in K.ROUTES]
    cases = " ".join(f"WHEN s[{i + 1}] = list_max(s) THEN '{n}'" for i, n in enumerate(names))
    return f"(SELECT *, CASE WHEN list_max(s) = 0 THEN 'summary' {cases} END AS route FROM (SELECT *, [{', '.join(scores)}] AS s FROM (SELECT *, lower({column}) AS q FROM "


@query("question_routes", over_ledger(f"SELECT session_id, turn, route FROM {_route_sql('text')} questions)))", QUESTIONS))
def _(spark, sf):
    return text.with_route(derived.questions(spark, sf)).select("session_id", "turn", "route")


@query("document_routes", f"SELECT route, count(*) AS n FROM {_route_sql('text')} documents))) GROUP BY 1")
def _(spark, sf):
    return text.with_route(table(spark, sf, "documents").select("text")).groupBy("route").agg(F.count("*").alias("n"))


MENTIONS = r"""mentions AS (SELECT session_id, turn,
  CASE WHEN list_contains(ms, iso) THEN iso WHEN contains(q, 'last month') THEN ms[greatest(len(ms) - 1, 1)] ELSE coalesce(NAMES) END AS month,
  CAST(coalesce(nullif(regexp_extract(q, '(?:^|[^\p{L}\p{N}_])(?:transaction|txn|id)\s+([0-9]{1,18})(?:$|[^\p{L}\p{N}_])', 1), ''), nullif(regexp_extract(q, '(?:^|[^\p{L}\p{N}_])([0-9]{1,18})(?:$|[^\p{L}\p{N}_])', 1), '')) AS BIGINT) AS transaction_id,
  CATS AS category
  FROM (SELECT *, regexp_extract(q, '[0-9]{4}-[0-9]{2}', 0) AS iso FROM (SELECT *, lower(text) AS q FROM questions)), (SELECT list(DISTINCT substr(date, 1, 7) ORDER BY substr(date, 1, 7)) AS ms FROM ledger))""".replace(
    "NAMES",
    ", ".join(f"CASE WHEN contains(q, '{m}') THEN list_max(list_filter(ms, lambda x: substr(x, 6, 2) = '{i:02d}')) END" for i, m in enumerate(text.MONTH_NAMES, 1)),
).replace("CATS", "coalesce(" + ", ".join(f"CASE WHEN contains(q, '{c}') THEN '{c}' END" for c in reversed(K.SPENDING_CATEGORIES)) + ")")


def _mentions(spark, sf):
    months = ledger(spark, sf).select(C.month_of().alias("m")).distinct().agg(F.sort_array(F.collect_list("m"))).scalar()
    q = derived.questions(spark, sf).withColumn("_months", months)
    return q.select(
        "session_id",
        "turn",
        text.month_mention(F.col("text"), F.col("_months")).alias("month"),
        text.transaction_mention(F.col("text")).alias("transaction_id"),
        text.category_mention(F.col("text")).alias("category"),
    )


@query("question_mentions", over_ledger("SELECT * FROM mentions", QUESTIONS, MENTIONS))
def _(spark, sf):
    return _mentions(spark, sf)


@query(
    "carried_context",
    over_ledger(
        "SELECT session_id, turn, last_value(month IGNORE NULLS) OVER w AS month_context, last_value(category IGNORE NULLS) OVER w AS category_context FROM mentions WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING)",
        QUESTIONS, MENTIONS,
    ),
)
def _(spark, sf):
    out = text.carry_forward(_mentions(spark, sf), "session_id", "turn", ["month", "category"], block_rows=20_000)
    return out.select("session_id", "turn", "month_context", "category_context")


ANSWERS = f"""facts AS (SELECT persona_id, month, {rnd('income', 2)} AS income, {rnd('expenses', 2)} AS expenses, {rnd('100.0::DOUBLE * expenses / nullif(income, 0)', 1)} AS pct FROM months),
answers AS (SELECT *, month || ': income $' || format('{{:,.2f}}', income + CASE WHEN suffix(month, '-07') THEN 1 ELSE 0 END) || ', expenses $' || format('{{:,.2f}}', expenses)
  || coalesce(' or ' || format('{{:.1f}}', pct + CASE WHEN suffix(month, '-11') THEN 2 ELSE 0 END) || '% of income', '') AS text FROM facts)"""


@query(
    "ungrounded_figures",
    over_ledger(
        """SELECT persona_id, month, kind, value FROM (
          SELECT persona_id, month, 'amount' AS kind, round_even(CAST(replace(replace(unnest(regexp_extract_all(text, '(-?\\$[0-9,]+(?:\\.[0-9]+)?)', 1)), '$', ''), ',', '') AS DOUBLE), 2) AS value FROM answers
          UNION ALL SELECT persona_id, month, 'percent', round_even(CAST(unnest(regexp_extract_all(text, '(-?[0-9]+(?:\\.[0-9]+)?)%', 1)) AS DOUBLE), 2) FROM answers) c
        ANTI JOIN (SELECT persona_id, month, 'amount' AS kind, income AS value FROM facts UNION ALL SELECT persona_id, month, 'amount', expenses FROM facts UNION ALL SELECT persona_id, month, 'percent', pct FROM facts) f USING (persona_id, month, kind, value)""",
        FOCAL_ALL, MONTHS_SQL, ANSWERS,
    ),
)
def _(spark, sf):
    from ledgerloom.operators import filters

    months = rollups.monthly_income_expenses(filters.focal(ledger(spark, sf), account_type="all"), BY)
    facts = months.select("persona_id", "month", "income", "expenses", C.rnd(F.try_divide(100.0 * F.col("expenses"), F.col("income")), 1).alias("pct"))
    off = lambda end, by: F.when(F.col("month").endswith(end), by).otherwise(0.0)
    answers = facts.select(
        "persona_id",
        "month",
        F.concat(
            F.col("month"), F.lit(": income "), C.money(F.col("income") + off("-07", 1.0)), F.lit(", expenses "), C.money(F.col("expenses")),
            F.coalesce(F.concat(F.lit(" or "), F.format_string("%.1f", F.col("pct") + off("-11", 2.0)), F.lit("% of income")), F.lit("")),
        ).alias("text"),
    )
    stated = F.array(
        F.struct(F.lit("amount").alias("kind"), F.col("income").alias("value")),
        F.struct(F.lit("amount").alias("kind"), F.col("expenses").alias("value")),
        F.struct(F.lit("percent").alias("kind"), F.col("pct").alias("value")),
    )
    keys = ["persona_id", "month"]
    return text.ungrounded(text.figures(answers, keys), facts.select(*keys, F.inline(stated)), keys)


# ---------------------------------------------------------------- alerts
SCANS = "flagged AS (SELECT CAST(ts AS DATE) AS scan, user_id AS row_index FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING max(value) >= 120)"


def _scans(spark, sf):
    """Users flagged per daily scan: an error of at least 120 that day."""
    day = F.to_date("ts").alias("scan")
    errors = table(spark, sf, "events").where(F.col("event_type") == "error").groupBy(day, F.col("user_id").alias("row_index"))
    return errors.agg(F.max("value").alias("v")).where(F.col("v") >= 120).select("scan", "row_index")


@query(
    "alert_episodes",
    with_ctes(
        "SELECT CAST(scan AS VARCHAR) AS scan, row_index FROM (SELECT *, lag(n) OVER (PARTITION BY row_index ORDER BY n) AS p FROM (SELECT *, dense_rank() OVER (ORDER BY scan) AS n FROM flagged)) WHERE p IS NULL OR p < n - 1",
        SCANS,
    ),
)
def _(spark, sf):
    return alerts.alert_episodes(_scans(spark, sf)).withColumn("scan", F.col("scan").cast("string"))


@query(
    "new_alerts",
    with_ctes(
        "SELECT row_index FROM flagged WHERE scan = (SELECT max(scan) FROM flagged) AND row_index NOT IN (SELECT row_index FROM flagged WHERE scan = (SELECT max(scan) FROM flagged WHERE scan < (SELECT max(scan) FROM flagged)))",
        SCANS,
    ),
)
def _(spark, sf):
    scans = _scans(spark, sf)
    last = scans.agg(F.max("scan")).scalar()
    before = scans.where(F.col("scan") < last).agg(F.max("scan")).scalar()
    return alerts.new_alerts(scans.where(F.col("scan") == last).select("row_index"), scans.where(F.col("scan") == before))


@query(
    "alert_payload",
    over_ledger(
        "SELECT row_id AS row_index, json_object('row_index', row_id, 'date', date, 'merchant', merchant, 'amount', amount, 'category', category, 'type', type, 'risk_score', risk_score, 'rule_score', rule_score, 'model_score', model_score, 'reason', reason, 'fraud_archetype', fraud_archetype)::VARCHAR AS payload, (SELECT greatest(count(*) - 25, 0) FROM scored WHERE risk_score >= 0.7) AS left_out FROM scored WHERE risk_score >= 0.7 ORDER BY risk_score DESC, row_id LIMIT 25",
        *SCORED_CTES,
    ),
)
def _(spark, sf):
    rows = _scored(spark, sf).where(F.col("risk_score") >= 0.7).withColumnRenamed("row_id", "row_index")
    return alerts.payload_rows(rows)


@query(
    "visible_labels",
    over_ledger("SELECT simulation_year, count(*) AS labels, count(*) FILTER (label_reported_at_step <= 30000) AS visible FROM ledger WHERE isFraud = 1 AND step <= 30000 GROUP BY 1"),
)
def _(spark, sf):
    seen = F.col("label_reported_at_step") <= 30_000
    return ledger(spark, sf).where((F.col("isFraud") == 1) & (F.col("step") <= 30_000)).groupBy("simulation_year").agg(
        F.count("*").alias("labels"), F.count_if(seen).alias("visible")
    )
