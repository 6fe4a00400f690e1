"""The sections of the monthly report beyond month, categories and risk: per persona, as one long table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import filters, reports, rollups, rules
from ledgerloom.plans.registry import query
from ledgerloom.plans.rollup_queries import BUDGET_SQL, BY, FOCAL, FOCAL_ALL, FORECAST_SQL, GOALS_SQL, HEALTH_SQL, LATEST, SPEND_SQL, _recurring_sql
from ledgerloom.plans.rule_queries import SCORED_CTES, _scored
from ledgerloom.plans.sqlkit import over_ledger, rnd
from ledgerloom.sources.ledger import ledger

_NUMBERED = "row_number() OVER (ORDER BY {order})"


def _section(name: str, label: str, value: str, order: str, source: str) -> str:
    return f"SELECT '{name}' AS section, {_NUMBERED.format(order=order)} AS position, {label} AS label, CAST({value} AS DOUBLE) AS value FROM {source}"


@query(
    "monthly_report_sections",
    over_ledger(
        " UNION ALL ".join(
            [
                _section("budget", "persona_id || ': ' || category", rnd("used", 3), f"persona_id, {rnd('used', 3)} DESC, category", "status"),
                _section("recurring", "merchant", "amount", "amount DESC, merchant", "recurring"),
                f"SELECT 'spikes', 1, 'transactions', count(*) FROM spikes UNION ALL SELECT 'spikes', 2, 'total', {rnd('coalesce(sum(amount), 0.0)', 2)} FROM spikes",
                _section("health", "persona_id", "score", "persona_id", "health"),
                _section("forecast", "persona_id || ': ' || trend", "forecast_expenses", "persona_id", "forecast"),
                _section(
                    "tips",
                    "persona_id || ': ' || CASE WHEN savings_rate < 0.20 THEN 'raise_savings' WHEN subscription_ratio > 0.05 THEN 'trim_subscriptions' ELSE 'keep_it_up' END",
                    "(SELECT least(count(*), 5) FROM scored WHERE risk_score >= 0.7)", "persona_id", "health JOIN forecast USING (persona_id)",
                ),
            ]
        ),
        *SCORED_CTES,
        FOCAL_ALL.replace("focal AS", "every AS"),
        LATEST.replace("FROM focal", "FROM every"),
        SPEND_SQL, GOALS_SQL, BUDGET_SQL,
        "regulars AS (SELECT * FROM ledger WHERE is_focal_user)",
        _recurring_sql("regulars", ""),
        FOCAL, HEALTH_SQL, FORECAST_SQL,
    ),
)
def _(spark, sf):
    """Budgets, recurring payments, spikes, health, forecast and tips: what the report says after the first three sections."""
    whole = ledger(spark, sf)
    every = filters.focal(whole, account_type="all")
    checking = filters.focal(whole)
    health, forecast = rollups.financial_health(checking.where("is_focal_user"), BY), rollups.forecast_next_month(checking, BY)
    shown = rules.top_risk(_scored(spark, sf), 5, ["row_id", "risk_score"]).agg(F.count("*")).scalar()
    persona = F.col("persona_id")
    told = lambda c: F.concat(persona, F.lit(": "), F.col(c))
    budgets = rollups.budget_status(filters.for_month(every, whole), rollups.budget_goals(spark), BY)
    recurring = rollups.recurring_payments(whole.where("is_focal_user"), max_amount_cv=0.7, max_interval_cv=1.2)
    return reports.combine(
        [
            reports.section(budgets, "budget", told("category"), F.col("pct"), [persona, F.desc("pct"), F.col("category")]),
            reports.section(recurring, "recurring", F.col("merchant"), F.col("amount"), [F.desc("amount"), F.col("merchant")]),
            reports.figures(rollups.spike_summary(rules.spend_spikes(whole)), "spikes", ["transactions", "total"]),
            reports.section(health, "health", persona, F.col("score"), [persona]),
            reports.section(forecast, "forecast", told("trend"), F.col("forecast_expenses"), [persona]),
            reports.section(rollups.tips(health, forecast, shown, BY), "tips", told("tip"), F.col("flagged"), [persona]),
        ]
    )
