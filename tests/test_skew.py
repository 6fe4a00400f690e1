"""The hot-key paths give what the plain paths give."""

import numpy as np
import pytest
from ledgers import ledger, random_rows
from pyspark.sql import functions as F

from ledgerloom.operators import balances, blocks, detectors, quality, text, usage
from ledgerloom.operators.features import FEATURES, build_features


@pytest.fixture(scope="module")
def skewed(spark):
    # one account holds a good third of all rows
    return ledger(spark, random_rows(7, 400, hot_share=0.35)).cache()


def same(a, b):
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0


def test_features(spark, skewed):
    plain = build_features(skewed)
    blocked = build_features(skewed, hot_rows=60, block_rows=25)
    rounded = lambda d: d.select("row_id", *[F.bround(c, 9).alias(c) for c in FEATURES])
    same(rounded(plain), rounded(blocked))


def test_features_with_blocks_shorter_than_the_frame(spark, skewed):
    rounded = lambda d: d.select("row_id", *[F.bround(c, 9).alias(c) for c in FEATURES])
    same(rounded(build_features(skewed)), rounded(build_features(skewed, hot_rows=10, block_rows=3)))


def test_balances(spark, skewed):
    same(balances.running_balances(skewed, 500.0), balances.running_balances(skewed, 500.0, hot_rows=60, block_rows=25))


@pytest.mark.parametrize("block_rows", range(1, 8))
def test_balances_with_many_rows_per_hour(spark, block_rows):
    """Hours hold more rows than a block, and transfers between two accounts put both sides into the same hour."""
    crowded = ledger(spark, random_rows(11, 60, accounts=2, steps=5, hot_share=0.4)).withColumn("amount", F.col("amount") + F.col("row_id") % 100 / 100)
    cents = lambda d: d.select("account", "step", "side", "row_id", *[F.round(c, 2).alias(c) for c in ("delta", "balance", "clamped")])
    plain = balances.running_balances(crowded, 500.0)
    same(cents(plain), cents(balances.running_balances(crowded, 500.0, hot_rows=10, block_rows=block_rows)))


@pytest.mark.parametrize("block_rows", [1, 2, 5, 7])
def test_other_blocks_with_many_rows_per_hour(spark, block_rows):
    crowded = ledger(spark, random_rows(12, 60, accounts=2, steps=5, hot_share=0.4)).cache()
    same(quality.chain_breaks(crowded), quality.chain_breaks(crowded, hot_rows=10, block_rows=block_rows))
    rounded = lambda d: d.select("row_id", *[F.bround(c, 9).alias(c) for c in FEATURES])
    same(rounded(build_features(crowded)), rounded(build_features(crowded, hot_rows=10, block_rows=block_rows)))


def test_chain(spark, skewed):
    same(quality.chain_breaks(skewed), quality.chain_breaks(skewed, hot_rows=60, block_rows=25))


def test_budget_guard(spark, skewed):
    turns = skewed.select(F.col("nameOrig").alias("session_id"), F.col("row_id").alias("turn"), F.col("amount").cast("long").alias("tokens"))
    same(usage.budget_guard(turns, 20, 9000), usage.budget_guard(turns, 20, 9000, hot_rows=60, block_rows=25))


def test_carry_forward(spark, skewed):
    rows = skewed.select(F.col("nameOrig").alias("s"), F.col("row_id").alias("turn"), F.when(F.col("amount") > 1700, F.col("merchant")).alias("m"))
    same(text.carry_forward(rows, "s", "turn", ["m"]), text.carry_forward(rows, "s", "turn", ["m"], block_rows=20))


def test_global_index_is_dense_and_ordered(spark, skewed):
    out = blocks.global_index(skewed.select("step", F.col("row_id").alias("src")), ["step", "src"], "i").orderBy("step", "src").collect()
    assert [r["i"] for r in out] == list(range(400))


def test_running_totals(spark, skewed):
    out = blocks.running_totals(skewed.select("row_id", F.lit(2).alias("two")), ["row_id"], {"upto": "two"}).orderBy("row_id").collect()
    assert [r["upto"] for r in out] == [2 * (i + 1) for i in range(400)]


def test_trailing_count(spark):
    rows = [(i, "k" if i % 3 else "j", i * 7_000_000) for i in range(80)]
    df = spark.createDataFrame(rows, "event_id long, key string, us long").withColumn("ts", F.timestamp_micros("us"))
    got = {r["event_id"]: r["hits"] for r in usage.trailing_count(df, "key", "ts", 60).collect()}
    want = {i: sum(1 for j, k2, u2 in rows if k2 == k and u - 60_000_000 < u2 <= u) for i, k, u in rows}
    assert got == want
    crowd = [(i, "k" if i % 3 else None, i // 5 * 20_000_000) for i in range(80)]
    df = spark.createDataFrame(crowd, "event_id long, key string, us long").withColumn("ts", F.timestamp_micros("us"))
    want = {i: sum(1 for j, k2, u2 in crowd if k2 == k and u - 60_000_000 < u2 <= u) for i, k, u in crowd}
    for block_rows in (1, 3, 7):
        got = {r["event_id"]: r["hits"] for r in usage.trailing_count(df, "key", "ts", 60, hot_rows=5, block_rows=block_rows).collect()}
        assert {i: n for i, n in got.items() if crowd[i][1]} == {i: n for i, n in want.items() if crowd[i][1]}


@pytest.mark.parametrize("block_rows", [1, 2, 3, 7])
def test_refund_loops_in_blocks(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    rows = [
        dict(step=int(rng.integers(60)), type=str(rng.choice(["SHOP", "CASH_IN"])), category="refund", amount=10.0, nameOrig="A", merchant=str(rng.choice(["M1", "M2"])))
        for _ in range(80)
    ]
    df = ledger(spark, rows).cache()
    same(detectors.refund_loop(df, 2), detectors.refund_loop(df, 2, hot_rows=5, block_rows=block_rows))

