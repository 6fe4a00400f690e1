"""Derived inputs of the usage, text and alert queries, in SQL."""

from ledgerloom import constants as K
from ledgerloom.plans.sqlkit import sql_list

CALLS = f"""calls AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS session_id,
  CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 'llm' ELSE 'narrator' END AS kind,
  {sql_list([*K.PRICING, 'unlisted'])}[1 + user_id % 5] AS model,
  k * 10 AS input_tokens, k * 3 AS output_tokens, value AS latency_ms, event_type <> 'error' AS ok, event_type,
  {sql_list(K.GATED_ENDPOINTS)}[1 + k % 10] AS route
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""
PRICES = "prices AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, (i, o) in K.PRICING.items()) + ") AS t(model, pi, po))"
COSTED = f"""costed AS (SELECT c.*, input_tokens / 1000000.0::DOUBLE * coalesce(pi, {K.DEFAULT_PRICE[0]}::DOUBLE)
  + output_tokens / 1000000.0::DOUBLE * coalesce(po, {K.DEFAULT_PRICE[1]}::DOUBLE) AS est_cost FROM calls c LEFT JOIN prices USING (model))"""
QUESTIONS = """questions AS (SELECT persona_id AS session_id, row_id AS turn, CASE row_id % 9
  WHEN 0 THEN 'How much did I spend on ' || category || ' in ' || substr(date, 1, 7) || '?'
  WHEN 1 THEN 'Any suspicious activity last month at ' || merchant || '?'
  WHEN 2 THEN 'What is similar to transaction ' || (row_id % 10000) || ' at ' || merchant
  WHEN 3 THEN 'Am I on track with my ' || category || ' budget?'
  WHEN 4 THEN 'Give me a forecast for ' || ['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december'][1 + row_id % 12]
  WHEN 5 THEN 'hello, what can you do'
  WHEN 6 THEN 'and what about ' || merchant || '?'
  WHEN 7 THEN 'Show my recurring subscriptions'
  ELSE 'Look up ' || (row_id % 5000) || ' please' END AS text FROM ledger)"""
