"""Usage accounting: session totals, costs, budgets, endpoint latency gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions import columns as C
from ledgerloom.operators.blocks import BLOCK_ROWS, HOT_ROWS, HotKeys, global_index, prior_totals


def tokens(text: Column) -> Column:
    """About four characters per token."""
    return F.floor(F.length(text) / 4)


def prices(spark: SparkSession, listed: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Input and output price per million tokens; `listed` adds models to the known tiers or reprices them."""
    rows = [(m, float(i), float(o)) for m, (i, o) in {**K.PRICING, **(listed or {})}.items()]
    return spark.createDataFrame(rows, "model string, input_per_1m double, output_per_1m double")


def with_cost(
    calls: DataFrame, name: str = "est_cost", listed: Mapping[str, tuple[float, float]] | None = None, default: tuple[float, float] = K.DEFAULT_PRICE
) -> DataFrame:
    """Price of each call; models on no list cost the default. A price list is a few hundred rows at most."""
    pi, po = F.coalesce("input_per_1m", F.lit(default[0])), F.coalesce("output_per_1m", F.lit(default[1]))
    cost = F.col("input_tokens") / 1e6 * pi + F.col("output_tokens") / 1e6 * po
    return (
        calls.join(F.broadcast(prices(calls.sparkSession, listed)), "model", "left")
        .withColumn(name, cost)
        .drop("input_per_1m", "output_per_1m")
    )


def session_totals(calls: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Counters per session over calls (kind, input_tokens, output_tokens, est_cost, latency_ms, ok)."""
    machine = F.col("kind") == "llm"
    return calls.groupBy(*by).agg(
        F.count("*").alias("calls"),
        F.count_if(machine).alias("llm_calls"),
        F.count_if(~machine).alias("narrator_calls"),
        F.count_if(machine & ~F.col("ok")).alias("failed_calls"),
        F.coalesce(F.sum(F.when(machine, F.col("input_tokens"))), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(machine, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"),
        # decimals: the sum must not depend on the order of the rows
        C.rnd(F.coalesce(F.sum(F.when(machine, C.rnd("est_cost", 6).cast("decimal(18,6)"))), F.lit(0)).cast("double"), 6).alias("est_cost"),
        C.rnd(F.coalesce(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), F.lit(0.0)), 1).alias("avg_latency_ms"),
    )


def usage_counters(stored: DataFrame, new_events: DataFrame) -> DataFrame:
    """Add increments to stored counters: an append and a sum instead of an upsert."""
    columns = ["session_id", "turns", "input_tokens", "output_tokens"]
    return (
        stored.select(*columns, "updated_at")
        .unionByName(new_events.select(*columns, "updated_at"))
        .groupBy("session_id")
        .agg(*[F.sum(c).alias(c) for c in columns[1:]], F.max("updated_at").alias("updated_at"))
    )


def recent_sessions(counters: DataFrame, limit: int = 100) -> DataFrame:
    return counters.orderBy(F.desc("updated_at"), "session_id").limit(limit)


def route_totals(requests: DataFrame) -> DataFrame:
    return requests.groupBy("route").agg(F.count("*").alias("requests"), F.sum("latency_ms").alias("latency_ms"))


def latency_gates(requests: DataFrame, limit_ms: float = 200.0, order: str = "event_id") -> DataFrame:
    """95th percentile per route, exact: element int(0.95 n) - 1 of the sorted latencies.

    One range-split order over (route, latency) replaces a sort per route, of
    which there are few and any may hold most of the rows.
    """
    placed = global_index(requests.select("route", "latency_ms", "ok", order), ["route", "latency_ms", order], "_i")
    counts = placed.groupBy("route").agg(
        F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("failures"), F.min("_i").alias("_first")
    )
    # routes are a handful, bounded by the service's own list
    wanted = counts.withColumn("_at", F.col("_first") + F.greatest(F.floor(F.col("requests") * 0.95) - 1, F.lit(0)))
    picked = placed.join(F.broadcast(wanted), "route").where(F.col("_i") == F.col("_at"))
    ok = (F.col("requests") > 0) & (F.col("latency_ms") < limit_ms) & (F.col("failures") == 0)
    return picked.select("route", "requests", "failures", F.col("latency_ms").alias("p95_ms"), ok.alias("passed"))


#: Rank error of a quantile read from a sketch of this size, by its documentation, with 99 % confidence.
SKETCH_K, RANK_ERROR = 800, 0.005


def latency_sketches(requests: DataFrame, by: Sequence[str | Column] = ("route",)) -> DataFrame:
    """Per group (say route and hour): requests, failures, and a quantile sketch of the latencies.

    Rows of this table add up: over hours, partitions, files and micro-batches. It is a plain
    aggregation with partial sketches on the map side, in a stream as in a batch.
    """
    return requests.groupBy(*by).agg(
        F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("failures"),
        F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), SKETCH_K).alias("latencies"),
    )


def sketched_gates(sketches: DataFrame, limit_ms: float = 200.0, share: float = 0.95) -> DataFrame:
    """The gates of `latency_gates` from added-up sketches; the quantile is within `RANK_ERROR` of the exact rank."""
    whole = sketches.groupBy("route").agg(F.sum("requests").alias("requests"), F.sum("failures").alias("failures"), F.kll_merge_agg_double("latencies", SKETCH_K).alias("s"))
    at = F.kll_sketch_get_quantile_double("s", F.lit(share))
    return whole.select("route", "requests", "failures", at.alias("p95_ms"), ((at < limit_ms) & (F.col("failures") == 0)).alias("passed"))


def never_exercised(requests: DataFrame, required: Sequence[str] = tuple(K.GATED_ENDPOINTS)) -> DataFrame:
    names = requests.sparkSession.createDataFrame([(r,) for r in required], "route string")
    return names.join(requests.select("route").distinct(), "route", "left_anti")


def cost_projection(calls: DataFrame, users: float, machine_share: float, questions: float) -> DataFrame:
    """Monthly cost: users x share x questions x 30 x mean cost per question."""
    return calls.agg(
        C.rnd(F.avg("est_cost"), 8).alias("per_question"),
        C.rnd(F.lit(users * machine_share * questions * 30.0) * F.avg("est_cost"), 4).alias("monthly_cost"),
    )


def trailing_count(
    df: DataFrame, key: str, ts: str, seconds: int, name: str = "hits", hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Events of the same key in (t - seconds, t], for every event with a time; 0 without one.

    Events shrink to one row per key and instant. Each adds its count when it
    comes and takes it back `seconds` later, so the answer is a running sum,
    which `HotKeys` cuts into blocks for a dominant key.
    """
    timed = df.withColumn("_us", C.epoch_micros(df, ts))
    each = timed.groupBy(key, "_us").agg(F.count("*").alias("_n")).where(F.col("_us").isNotNull())
    gone = each.select(key, (F.col("_us") + seconds * 1_000_000).alias("_us"), F.lit(0).alias("_come"), (-F.col("_n")).alias("_n"))
    marks = each.select(key, "_us", F.lit(1).alias("_come"), "_n").unionByName(gone)
    keys = HotKeys(marks, [key], "_at", hot_rows, block_rows)
    if keys.found:
        marks = global_index(marks, ["_us", "_come", key], "_at")
    upto = Window.partitionBy(key, "_blk").orderBy("_us", "_come").rowsBetween(Window.unboundedPreceding, 0)
    carried = prior_totals(keys.only(marks), [key], {"_before": ("sum", F.col("_n"))})
    summed = keys.carry(keys.blocks(marks).withColumn("_in", F.sum("_n").over(upto)), carried, {"_before": "long"})
    counts = summed.where("_come = 1").select(
        F.col(key).alias("_key"), F.col("_us").alias("_when"), (F.col("_in") + F.coalesce("_before", F.lit(0))).alias(name)
    )
    out = timed.join(counts, timed[key].eqNullSafe(counts["_key"]) & (timed["_us"] == counts["_when"]), "left")
    return out.withColumn(name, F.coalesce(name, F.lit(0))).drop("_us", "_key", "_when")


def budget_guard(
    turns: DataFrame,
    max_turns: int = 20,
    max_tokens: int = 20_000,
    key: str = "session_id",
    order: str = "turn",
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Would this turn still be allowed, given what the session used before it?"""
    keys = HotKeys(turns, [key], order, hot_rows, block_rows)
    earlier = Window.partitionBy(key, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = prior_totals(keys.only(turns), [key], {"_n": ("sum", F.lit(1).cast("long")), "_t": ("sum", F.col("tokens"))})
    counted = keys.blocks(turns).withColumn("_bn", F.count("*").over(earlier)).withColumn("_bt", F.sum("tokens").over(earlier))
    used = (
        keys.carry(counted, carried, {"_n": "long", "_t": "long"})
        .withColumn("turns_used", F.col("_bn") + F.coalesce("_n", F.lit(0)))
        .withColumn("tokens_used", F.coalesce("_bt", F.lit(0)) + F.coalesce("_t", F.lit(0)))
    )
    refused = (
        F.when(F.col("turns_used") >= max_turns, "turn budget")
        .when(F.col("tokens_used") + F.col("tokens") > max_tokens, "token budget")
        .otherwise("")
    )
    return used.select(key, order, "tokens", "turns_used", "tokens_used", refused.alias("refused"))
