"""Top-k products against all pairs in plain integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import top_products

SCHEMA = "vec_id long, embedding array<double>, score string, Rank int"


def plain(rows, k=20, scale=64, asked=lambda i: i % 20 == 0):
    kept = []
    for i, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [min(max(math.floor(scale * x), -(1 << 24)), 1 << 24) for x in v]))
    out = []
    for n, (i, v) in enumerate(kept):
        if i is None or not asked(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for m, (j, w) in enumerate(kept) if m != n]
        for rank, (s, _, _, j) in enumerate(sorted(scored, key=lambda t: t[:3])[:k], 1):
            out.append((i, rank, j, -s))
    return sorted(out, key=lambda r: (r[0], r[1], -r[3], r[2] is None, r[2] or 0))


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    out = top_products.search(table.repartition(5), F.col("vec_id") % 20 == 0, **options)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted([tuple(r) for r in out.collect()], key=lambda r: (r[0], r[1], -r[3], r[2] is None, r[2] or 0))


def test_many_tiles_and_waves(spark, monkeypatch):
    monkeypatch.setattr(top_products, "_TILE_BYTES", 1)  # 16 vectors a tile
    rng = np.random.default_rng(5)
    lengths = rng.lognormal(0, 1, 1500)
    rows = [(int(i), (rng.normal(size=24) * np.geomspace(1, 0.05, 24) * n).tolist()) for i, n in enumerate(lengths)]
    counted = {}
    assert run(spark, rows, counted=counted) == plain(rows)
    assert counted["waves"] > 3
    assert counted["met"] < 0.5 * counted["all"]  # short vectors were never met
    assert counted["full"] < 0.6 * counted["met"]  # most of the met ones fell to partial sums


def test_equal_lengths_and_ties(spark, monkeypatch):
    monkeypatch.setattr(top_products, "_TILE_BYTES", 1)
    rng = np.random.default_rng(6)
    base = rng.integers(-2, 3, size=(7, 8)) / 64
    rows = [(int(i), base[i % 7].tolist()) for i in rng.permutation(400)]
    assert run(spark, rows, k=5) == plain(rows, 5)


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(41)]
    rows += [(0, rows[0][1]), (20, rows[3][1]), (None, rows[3][1]), (None, rows[5][1])]  # repeated ids, ids missing
    rows += [(60, None), (80, [1.0, None]), (100, [float("nan")] * 6), (120, [float("inf")] + [0.0] * 5)]
    rows += [(140, []), (160, [1.5]), (161, rng.normal(size=9).tolist()), (180, [0.0] * 6), (200, [1e300, -1e300]), (201, [1e300])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, k=100) == plain(rows, 100)


@pytest.mark.parametrize("rows", [[], [(0, None)], [(1, [1.0, 2.0])], [(0, [1.0, 2.0])], [(0, [-1.0]), (20, [2.0])]])
def test_few_rows(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_every_row_asks(spark):
    rows = [(i, [float(i % 5), -float(i % 3)]) for i in range(30)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in top_products.search(table, k=3).collect())
    assert got == sorted(plain(rows, 3, asked=lambda i: True))
