"""Inputs the usage, text and alert queries derive from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.operators.text import MONTH_NAMES
from ledgerloom.sources.ledger import ledger
from ledgerloom.sources.tables import table


def _pick(values: list[str], position):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


def calls_from(events: DataFrame) -> DataFrame:
    """Every event as one call of a session: kind, tokens, latency, success, route."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("event_type").isin("click", "purchase", "error"), "llm").otherwise("narrator").alias("kind"),
        _pick([*K.PRICING, "unlisted"], F.col("user_id") % 5).alias("model"),
        (k * 10).alias("input_tokens"),
        (k * 3).alias("output_tokens"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") != "error").alias("ok"),
        "event_type",
        _pick(K.GATED_ENDPOINTS, k % 10).alias("route"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_from(table(spark, sf_dir, "events"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per transaction, phrased in nine ways."""
    i = F.col("row_id")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    merchant, category = F.col("merchant"), F.col("category")
    text = (
        F.when(i % 9 == 0, cat("How much did I spend on ", category, " in ", F.substring("date", 1, 7), "?"))
        .when(i % 9 == 1, cat("Any suspicious activity last month at ", merchant, "?"))
        .when(i % 9 == 2, cat("What is similar to transaction ", (i % 10000).cast("string"), " at ", merchant))
        .when(i % 9 == 3, cat("Am I on track with my ", category, " budget?"))
        .when(i % 9 == 4, cat("Give me a forecast for ", _pick(MONTH_NAMES, i % 12)))
        .when(i % 9 == 5, F.lit("hello, what can you do"))
        .when(i % 9 == 6, cat("and what about ", merchant, "?"))
        .when(i % 9 == 7, F.lit("Show my recurring subscriptions"))
        .otherwise(cat("Look up ", (i % 5000).cast("string"), " please"))
    )
    return ledger(spark, sf_dir).select(F.col("persona_id").alias("session_id"), i.alias("turn"), text.alias("text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with their estimated tokens."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", "text", F.floor(F.length("text") / 4).alias("tokens")
    )
