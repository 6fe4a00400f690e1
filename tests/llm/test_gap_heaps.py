"""k-means with gap heaps against plain rounds over all vectors."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import gap_heaps

SCHEMA = "vec_id long, embedding array<double>, cluster string, Distance int"

def first():
    return F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)


def plain(rows, k=40, rounds=5, length=64, scale=256):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [min(max(math.floor(scale * x), -(1 << 27)), 1 << 27) for x in v]))
    packed = lambda v: np.array(v, dtype="<i4").tobytes()
    named = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, named(r[0]), packed(r[1])))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        at = [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, m) in zip(kept, at) if m == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, n, d) for (i, _), (d, n) in zip(kept, at)), key=str), centroids


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    found, centroids = gap_heaps.cluster(table.repartition(4), first(), **options)
    whole = gap_heaps.with_inertia(found, centroids)
    got = whole.collect()
    total = sum(r["distance"] for r in got)
    for r in got:
        assert r["inertia"] == min(total, 2**63 - 1)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
        assert r["cluster_inertia"] == min(sum(q["distance"] for q in got if q["cluster"] == r["cluster"]), 2**63 - 1)
    return sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str), centroids


def test_rescans_fall(spark, monkeypatch):
    monkeypatch.setattr(gap_heaps, "_BLOCK", 100)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 8)) * 4
    rows = [(int(i), (middle[i % 12] + rng.normal(size=8)).tolist()) for i in rng.permutation(1200)]
    counted = []
    assert run(spark, rows, k=12, rounds=6, length=8, counted=counted) == plain(rows, 12, 6, 8)
    assert counted[0] == 1200
    assert counted[-1] < 600  # most gaps hold


def test_ties_everywhere(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-2, 3, size=4) / 256).tolist()) for i in range(300)]
    assert run(spark, rows, k=9, rounds=5, length=4) == plain(rows, 9, 5, 4)


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(30)]
    rows += [rows[0], rows[0], (3, rows[7][1]), (None, rows[4][1]), (None, [0.5] * 5)]
    rows += [(50, None), (51, [1.0, None, 1.0, 1.0, 1.0]), (52, [float("nan")] * 5), (53, [1.0] * 4), (54, []), (55, [float("-inf")] * 5)]
    rows += [(56, [1e300] * 5), (57, [-1e300] * 5)]
    assert run(spark, rows, k=6, length=5) == plain(rows, 6, 5, 5)
    assert run(spark, rows, k=50, length=5) == plain(rows, 50, 5, 5)
    assert run(spark, rows, k=1, length=5) == plain(rows, 1, 5, 5)


def test_equal_vectors(spark):
    rows = [(i, [0.25, -0.5]) for i in range(50)]
    assert run(spark, rows, k=4, length=2) == plain(rows, 4, 5, 2)


def test_empty(spark):
    assert run(spark, [], k=4, length=2) == ([], [])
    assert run(spark, [(1, None)], k=4, length=2) == ([], [])
