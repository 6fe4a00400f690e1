"""File formats, the store, reports and run records: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import evaluation as E
from ledgerloom.operators import filters, reports, rollups, rules
from ledgerloom.operators.features import FEATURES, build_features
from ledgerloom.plans.registry import query
from ledgerloom.plans.rollup_queries import _EXPLORE, EXPLORE_SQL
from ledgerloom.plans.rule_queries import SCORED_CTES, _scored
from ledgerloom.plans.evaluation_queries import MODELS_SQL, _metrics_sql, _recall_sql
from ledgerloom.plans.sqlkit import CREDIT, EXPENSE, over_ledger, rnd
from ledgerloom.session import new_path
from ledgerloom.sources import files
from ledgerloom.sources.ledger import labeled_scores, ledger
from ledgerloom.sources.store import LedgerStore
from ledgerloom.sources.tables import table

SAMPLE = "row_id, step, type, amount, merchant, anomaly_type, is_focal_user, simulation_year"


@query("csv_round_trip", over_ledger(f"SELECT {SAMPLE} FROM ledger"))
def _(spark, sf):
    from ledgerloom.sources.conform import null_text_to_empty

    path = new_path(spark, "ledger.csv")
    files.write_ledger(ledger(spark, sf), path)
    return null_text_to_empty(files.load_ledger(spark, path)).select(*SAMPLE.split(", "))


@query("parquet_round_trip", over_ledger("SELECT * FROM ledger"))
def _(spark, sf):
    """All years and columns."""
    path = new_path(spark, "ledger") + ".parquet"
    whole = ledger(spark, sf)
    files.write_ledger(whole, path)
    return files.load_ledger(spark, path).select(*whole.columns)


@query(
    "ingest_unnumbered_ledger",
    over_ledger("SELECT row_number() OVER (ORDER BY step, nameOrig, nameDest, type, amount, category, score, row_id) - 1 AS row_id, step, nameOrig, amount FROM ledger JOIN scores USING (row_id, step)"),
)
def _(spark, sf):
    scores = labeled_scores(spark, sf).select("row_id", "score")
    bare = ledger(spark, sf).join(scores, "row_id").withColumnRenamed("row_id", "source_row")
    path = new_path(spark, "bare") + ".parquet"
    files.write_ledger(bare, path, partition=False)
    order = ["nameOrig", "nameDest", "type", "amount", "category", "score", "source_row"]
    return files.ingest_ledger(spark, path, order).select("row_id", "step", "nameOrig", "amount")


@query("export_filtered_csv", over_ledger("SELECT row_id, merchant, amount FROM explored", EXPLORE_SQL))
def _(spark, sf):
    path = new_path(spark, "export.csv")
    files.export_csv(filters.explore(ledger(spark, sf), **_EXPLORE).select("row_id", "merchant", "amount"), path)
    return files.read_csv(spark, path)


@query("json_lines_with_corrupt_rows", "SELECT event_id, event_type FROM events WHERE event_type <> 'signup'")
def _(spark, sf):
    """Every signup line is cut off on the way; the reader skips those."""
    line = F.to_json(F.struct("event_id", "event_type"))
    broken = F.when(F.col("event_type") == "signup", F.substring(line, 1, 9)).otherwise(line)
    path = new_path(spark, "events.jsonl")
    table(spark, sf, "events").select(broken.alias("value")).write.text(path)
    return files.read_json_lines(spark, path, "event_id long, event_type string")


@query("activity_log_tail", "SELECT event_type AS tool, round_even(value, 1) AS latency_ms, event_type <> 'error' AS ok FROM events ORDER BY ts DESC LIMIT 15")
def _(spark, sf):
    from ledgerloom.functions.columns import epoch_micros

    events = table(spark, sf, "events")
    records = events.select(
        (epoch_micros(events, "ts") / 1e6).alias("ts"),
        F.col("event_type").alias("tool"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("args"),
        F.bround("value", 1).alias("latency_ms"),
        (F.col("event_type") != "error").alias("ok"),
        F.lit("").alias("error"),
    )
    path = new_path(spark, "activity.jsonl")
    for part in (F.col("ok"), ~F.col("ok")):
        files.append_log(records.where(part), path)
    return files.log_tail(spark, path).select("tool", "latency_ms", "ok")


@query("result_table_round_trip", over_ledger("SELECT archetype, recall, recall AS precision, support FROM r", _recall_sql("score", "r")))
def _(spark, sf):
    path = new_path(spark, "archetypes.csv")
    recall = E.archetype_recall(labeled_scores(spark, sf))
    files.write_result_table(recall, path)
    return files.read_result_table(spark, path, recall.schema)


@query(
    "store_sync",
    over_ledger("SELECT true AS loaded, false AS loaded_again, true AS loaded_changed, (SELECT count(*) FROM ledger WHERE amount > 40) AS total, 0 AS scores_left"),
)
def _(spark, sf):
    store = LedgerStore(spark, new_path(spark, "store"))
    rows = ledger(spark, sf)
    first, second = store.sync(rows), store.sync(rows)
    store.materialize_scores(_scored(spark, sf), "m1")
    third = store.sync(rows.where(F.col("amount") > 40))
    return store.ledger().agg(
        F.lit(first).alias("loaded"), F.lit(second).alias("loaded_again"), F.lit(third).alias("loaded_changed"),
        F.count("*").alias("total"), F.lit(store.scores().count()).alias("scores_left"),
    )


@query(
    "store_partial_sync",
    over_ledger(
        """SELECT (SELECT count(*) FROM (SELECT DISTINCT simulation_year, row_id // 5000 FROM ledger)) AS blocks, 1 AS rewritten,
        count(*) AS total, sum(CAST(round_even(amount, 2) AS DECIMAL(38, 2)))::VARCHAR AS amount FROM (SELECT CASE WHEN row_id = 7 THEN amount + 1 ELSE amount END AS amount FROM ledger)"""
    ),
)
def _(spark, sf):
    """One changed row rewrites one block; the stored ledger is the changed one."""
    store = LedgerStore(spark, new_path(spark, "store"), block_rows=5000)
    rows = ledger(spark, sf)
    store.sync(rows)
    blocks = store.rewritten
    store.sync(rows.withColumn("amount", F.when(F.col("row_id") == 7, F.col("amount") + 1).otherwise(F.col("amount"))))
    total = F.sum(F.bround("amount", 2).cast("decimal(38,2)")).cast("string")
    return store.ledger().agg(
        F.lit(blocks).cast("long").alias("blocks"), F.lit(store.rewritten).alias("rewritten"), F.count("*").alias("total"), total.alias("amount")
    )


@query("store_risk_scan", over_ledger("SELECT row_id, date, amount, risk_score, rule_reason FROM scored WHERE risk_score >= 0.7 ORDER BY risk_score DESC, row_id LIMIT 15", *SCORED_CTES))
def _(spark, sf):
    store = LedgerStore(spark, new_path(spark, "store"))
    store.sync(ledger(spark, sf), "as-is")
    store.materialize_scores(_scored(spark, sf), "rules")
    return rules.top_risk(store.risk_rows(), 15, ["row_id", "date", "amount", "risk_score", "rule_reason"])


@query(
    "store_reset",
    over_ledger(
        """SELECT 'before' AS state, count(*) AS ledger_rows, count(*) FILTER (row_id % 3 = 0) AS score_rows FROM ledger
        UNION ALL SELECT 'reset', 0, 0 UNION ALL SELECT 'again', count(*) FILTER (amount > 40), 0 FROM ledger"""
    ),
)
def _(spark, sf):
    """What the store holds before a reset, after it, and after the next sync."""
    store = LedgerStore(spark, new_path(spark, "store"))
    rows = ledger(spark, sf)
    now = lambda state: (state, store.ledger().count(), store.scores().count())
    store.sync(rows, "x")
    zero = F.lit(0.0)
    scored = rows.where("row_id % 3 = 0").select("row_id", *[zero.alias(f"{c}_score") for c in ("risk", "rule", "model", "isolation")], F.lit("").alias("rule_reason"), F.lit("").alias("reason"))
    store.materialize_scores(scored, "x")
    states = [now("before")]
    store.reset()
    states.append(now("reset"))
    store.sync(rows.where("amount > 40"), "x")
    return spark.createDataFrame([*states, now("again")], "state string, ledger_rows long, score_rows long")


@query(
    "monthly_report",
    over_ledger(
        f"""SELECT 'month' AS section, 1 AS position, 'income' AS label, {rnd(f"coalesce(sum(amount) FILTER ({CREDIT} AND account_type = 'checking'), 0.0)", 2)} AS value FROM latest
        UNION ALL SELECT 'month', 2, 'expenses', {rnd(f'coalesce(sum(amount) FILTER ({EXPENSE}), 0.0)', 2)} FROM latest
        UNION ALL SELECT 'categories', row_number() OVER (ORDER BY amount DESC, category), category, {rnd('amount', 2)} FROM spend
        UNION ALL SELECT 'risk', row_number() OVER (ORDER BY risk_score DESC, row_id), merchant, risk_score FROM (SELECT * FROM scored WHERE risk_score >= 0.7 ORDER BY risk_score DESC, row_id LIMIT 12)""",
        "focal AS (SELECT * FROM ledger WHERE account_type <> 'background')",
        "latest AS (SELECT * FROM focal WHERE substr(date, 1, 7) = (SELECT max(substr(date, 1, 7)) FROM ledger))",
        f"spend AS (SELECT category, sum(amount) AS amount FROM latest WHERE {EXPENSE} AND category <> 'savings' GROUP BY 1)",
        *SCORED_CTES,
    ),
)
def _(spark, sf):
    whole = ledger(spark, sf)
    latest = filters.for_month(filters.focal(whole, account_type="all"), whole)
    top = rules.top_risk(_scored(spark, sf), 12, ["row_id", "merchant", "risk_score"])
    return reports.combine(
        [
            reports.figures(rollups.monthly_summary(latest), "month", ["income", "expenses"]),
            reports.section(rollups.category_breakdown(latest), "categories", F.col("category"), F.col("amount"), [F.desc("amount"), F.col("category")]),
            reports.section(top, "risk", F.col("merchant"), F.col("risk_score"), [F.desc("risk_score"), F.col("row_id")]),
        ]
    )


@query(
    "run_record",
    over_ledger(
        """SELECT pr_auc, (SELECT count(*) FROM ledger) AS transactions, (SELECT count(*) FROM r) AS archetypes,
        (SELECT count(DISTINCT cohort) FROM scores WHERE y = 1 AND cohort <> '') AS cohorts FROM metrics WHERE model = 'score'""",
        MODELS_SQL, _metrics_sql("models", "model"), _recall_sql("score", "r"),
    ),
)
def _(spark, sf):
    scores = labeled_scores(spark, sf)
    record = reports.run_record(
        E.metrics(scores), rollups.dataset_profile(ledger(spark, sf)), E.archetype_recall(scores), E.cohort_recall(scores)
    )
    path = new_path(spark, "run.json")
    record.write.json(path)
    return spark.read.schema(record.schema).json(path).select(
        F.col("holdout.pr_auc").alias("pr_auc"), F.col("dataset.transactions").alias("transactions"),
        F.size("archetype_recall").cast("long").alias("archetypes"), F.size("cohort_fairness").cast("long").alias("cohorts"),
    )


@query("prefix_invariance", over_ledger("SELECT 0 AS differing, (SELECT count(*) FROM ledger WHERE step <= 30000) AS compared"))
def _(spark, sf):
    """Features of a prefix equal those of the whole ledger: nothing looks ahead."""
    whole = ledger(spark, sf)
    prefix = build_features(whole.where(F.col("step") <= 30_000))
    full = build_features(whole).join(prefix.select("row_id"), "row_id", "left_semi")
    left, right = prefix.select("row_id", *FEATURES), full.select("row_id", *FEATURES)
    return left.exceptAll(right).agg(F.count("*").alias("differing")).withColumn("compared", prefix.agg(F.count("*")).scalar())
