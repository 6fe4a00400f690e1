"""Store, alert state, limiter, usage counters and files."""

import pandas as pd
import pytest
from ledgers import ledger, random_rows
from pyspark.sql import functions as F

from ledgerloom.operators import alerts, rules
from ledgerloom.operators.quality import fingerprint
from ledgerloom.sources import files
from ledgerloom.sources.store import LedgerStore
from ledgerloom.streaming.jobs import AlertState


def flagged(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "row_index long")


def test_alert_state_follows_the_flagged_set(spark, tmp_path):
    state, sent = AlertState(spark, str(tmp_path)), []
    deliver = lambda rows: sent.append(sorted(r[0] for r in rows.collect())) or True
    state.scan(flagged(spark, 1, 2), deliver)
    state.scan(flagged(spark, 1, 2), deliver)
    assert sent == [[1, 2]]
    state.scan(flagged(spark, 2), deliver)
    state.scan(flagged(spark, 1, 2), deliver)  # 1 dropped out and is a new episode
    assert sent == [[1, 2], [1]]
    state.scan(flagged(spark), deliver)  # an empty scan forgets nothing
    state.scan(flagged(spark, 1, 2), deliver)
    assert sent == [[1, 2], [1]]
    state.scan(flagged(spark, 1, 2, 3), lambda rows: False)  # failed: tried again
    state.scan(flagged(spark, 1, 2, 3), deliver)
    assert sent == [[1, 2], [1], [3]]


def test_alert_episodes_agree_with_the_state(spark, tmp_path):
    scans = {1: [1, 2], 2: [2], 4: [1, 2, 3], 7: [3], 8: [1]}
    df = spark.createDataFrame([(s, i) for s, ids in scans.items() for i in ids], "scan int, row_index long")
    state, want = AlertState(spark, str(tmp_path)), set()
    for s, ids in scans.items():
        state.scan(flagged(spark, *ids), lambda rows, s=s: want.update((s, r[0]) for r in rows.collect()) or True)
    assert {tuple(r) for r in alerts.alert_episodes(df).collect()} == want


def test_payload_is_capped_and_finite(spark):
    rows = spark.range(40).select(F.col("id").alias("row_index"), F.lit(1.0).alias("risk_score"), F.lit(float("nan")).alias("amount"), F.lit("x").alias("secret"))
    out = alerts.payload_rows(rows).collect()
    assert len(out) == 25 and out[0]["payload"] == '{"row_index":0,"amount":null,"risk_score":1.0}'


def test_streams_in_batches_drop_only_late_rows(spark):
    """Rows in time order all count, also those a little out of order; a row behind the watermark is dropped."""
    from ledgerloom.session import new_path
    from ledgerloom.streaming import jobs, runs

    def hits(*batches):
        folder = new_path(spark, "late")
        for batch in batches:
            rows = spark.createDataFrame([(m, "k", 1.0) for m in batch], "m long, k string, v double")
            rows.select(F.timestamp_seconds(F.col("m") * 60).alias("ts"), "k", "v").coalesce(1).write.mode("append").parquet(folder)
        schema = spark.read.parquet(folder).schema
        windows = jobs.windowed_spend(runs.stream_of(spark, folder, schema), "ts", "k", "v", "1 hour")
        out = runs.run_batches(windows, "late-windows", runs.keep_batch)
        latest = runs.latest_per_key(spark, out, ["window_start", "window_end", "k"], windows.schema)
        return latest.agg(F.sum("n")).first()[0]

    assert hits([0, 50], [90, 40], [200], [230]) == 6
    assert hits([0, 50], [300], [301], [10, 302]) == 5


def test_store_reloads_only_on_change(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "s"))
    df = ledger(spark, random_rows(1, 60))
    assert store.total_rows() == 0
    assert store.sync(df) and not store.sync(df.orderBy(F.desc("row_id"))) and store.total_rows() == 60
    scored = rules.blend(rules.rule_risk_flags(df))
    store.materialize_scores(scored, "a")
    assert store.has_scores("a") and not store.has_scores("b") and store.risk_rows().count() == 60
    assert store.sync(df.where("row_id < 50")) and store.scores().count() == 0
    assert [r["row_id"] for r in store.in_row_order().collect()] == list(range(50))
    store.reset()
    assert store.total_rows() == 0 and store.sync(df)


def test_one_changed_row_rewrites_one_block(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "s"), block_rows=10)
    df = ledger(spark, random_rows(1, 60)).cache()
    years = df.select("simulation_year", F.floor(F.col("row_id") / 10)).distinct().count()
    assert store.sync(df) and (store.rewritten, store.kept) == (years, 0)
    changed = df.withColumn("amount", F.when(F.col("row_id") == 33, 1.25).otherwise(F.col("amount")))
    assert store.sync(changed) and (store.rewritten, store.kept) == (1, years - 1)
    assert not store.sync(changed) and store.rewritten == 0
    same = lambda want: store.ledger().exceptAll(want).count() == 0 == want.exceptAll(store.ledger()).count()
    assert same(changed.select(*store.ledger().columns)) and store.total_rows() == 60
    fewer = changed.where("row_id < 30")
    assert store.sync(fewer) and store.rewritten == 0 and same(fewer.select(*store.ledger().columns))
    assert store.sync(df) and same(df.select(*store.ledger().columns))
    store.sync(df.where("row_id < 0"), "none")
    assert store.total_rows() == 0 == store.ledger().count()
    store.sync(df, "all")
    store.sync(changed, "one")
    left = [p.name for p in (tmp_path / "s" / "ledger-blocks").iterdir()]
    assert len(left) == 2  # the whole and the one block; nothing points at the others


def test_price_list(spark):
    from ledgerloom import constants as K
    from ledgerloom.operators import usage

    known = next(iter(K.PRICING))
    calls = spark.createDataFrame([(known, 10**6, 0), ("house-model", 10**6, 10**6), ("other", 10**6, 0)], "model string, input_tokens long, output_tokens long")
    cost = lambda **o: {r["model"]: r["est_cost"] for r in usage.with_cost(calls, **o).collect()}
    assert cost()["house-model"] == sum(K.DEFAULT_PRICE)
    own = cost(listed={"house-model": (2, 3), known: (7, 1)}, default=(0.5, 0.5))
    assert own == {known: 7.0, "house-model": 5.0, "other": 0.5}


def test_sketched_quantiles(spark):
    from ledgerloom.operators import usage
    from ledgerloom.plans.usage_queries import rank_check

    rows = spark.range(60_000).select(
        F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("route"), F.exp(F.randn(7) * 2).alias("latency_ms"), (F.col("id") > 3).alias("ok"), (F.col("id") % 24).alias("hour")
    ).cache()
    gates = usage.sketched_gates(usage.latency_sketches(rows, ["route", "hour"]), 1000.0)
    assert [(r["requests"], r["failures"], r["within"]) for r in rank_check(rows, gates).orderBy("route").collect()] == [(6000, 1, True), (54000, 3, True)]
    assert [r["passed"] for r in gates.collect()] == [False, False]


def test_fingerprint_ignores_order(spark):
    df = ledger(spark, random_rows(2, 40))
    assert fingerprint(df).first() == fingerprint(df.orderBy(F.desc("row_id"))).first()
    assert fingerprint(df).first() != fingerprint(df.where("row_id > 0")).first()


def test_fingerprint_counts_repeated_rows(spark):
    numbers = lambda *xs: fingerprint(spark.createDataFrame([(x, None) for x in xs], "x double, y string")).first()
    one, other = numbers(1.0, 1.0, 2.0), numbers(2.0, 3.0, 3.0)
    assert one["digest"] != other["digest"] and one["exact"] != other["exact"]
    assert numbers(1.0)["digest"] == numbers(1.0 + 1e-9)["digest"] and numbers(1.0)["exact"] != numbers(1.0 + 1e-9)["exact"]
    assert fingerprint(spark.createDataFrame([], "x double, y string")).first()["n"] == 0


def test_json_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"row_index": 1}\nnot json\n{"row_index": 2}\n')
    assert [r[0] for r in files.read_json_lines(spark, str(path), "row_index long").orderBy("row_index").collect()] == [1, 2]
    assert files.read_json_lines(spark, str(tmp_path / "none"), "row_index long").count() == 0


@pytest.mark.parametrize("name", ["l.csv", "l.parquet"])
def test_ledger_files(spark, tmp_path, name):
    df = ledger(spark, random_rows(4, 50))
    path = str(tmp_path / name)
    files.write_ledger(df.drop("row_id"), path)
    out = files.ingest_ledger(spark, path)
    assert out.dtypes == df.dtypes and out.count() == 50
    assert out.select("step", "amount", "anomaly_type").exceptAll(df.select("step", "amount", "anomaly_type")).count() == 0
    assert [r["step"] for r in out.orderBy("row_id").collect()] == sorted(r["step"] for r in df.collect())


def test_streamed_limiter_matches_a_plain_loop(spark, sf):
    from ledgerloom.plans import load
    from ledgerloom.plans.registry import QUERIES

    load()
    got = {r["event_id"]: r["allowed"] for r in QUERIES["stream_request_limiter"](spark, sf).collect()}
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts").toPandas().sort_values(["ts", "event_id"])
    hits, want = {}, {}
    for r in events.itertuples():
        recent = [t for t in hits.get(r.user_id, []) if t > r.ts - pd.Timedelta(seconds=21_600)]
        want[r.event_id] = len(recent) < 3
        hits[r.user_id] = [*recent, r.ts] if want[r.event_id] else recent
    assert got == want and not all(want.values())
