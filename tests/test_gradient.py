"""Gradient-trained models against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluation as E
from ledgerloom.operators import gangs
from ledgerloom.operators import gradient as G


def frame(spark, x, y=None):
    columns = [f"c{j}" for j in range(x.shape[1])]
    y = np.zeros(len(x)) if y is None else y
    rows = [(i, int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "row_id long, y int, " + ", ".join(f"{c} double" for c in columns)).repartition(3), columns


def labelled(n=400):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    return x, (x[:, 0] - 0.7 * x[:, 1] + rng.normal(scale=0.3, size=n) > 0.8).astype(int)


def plain_linear(x, y, p):
    """Number by number, in the order that the seed gives."""
    n, pos = len(y), int(y.sum())
    weight = [n / (2 * pos) if t else n / (2 * (n - pos)) for t in y]
    sign = [2 * int(t) - 1 for t in y]
    typical = (1 / p.regParam**0.5) ** 0.5
    first = 1 / (typical / 4 * p.regParam)
    w, best, least, waited = [0.0] * (x.shape[1] + 1), None, float("inf"), 0
    for epoch in range(p.maxIter):
        order = np.random.default_rng([p.seed, epoch, 0]).permutation(n).tolist()
        steps = -(-n // p.batch)
        mean, loss = [0.0] * len(w), 0.0
        for k in range(steps):
            rows = order[k * p.batch : (k + 1) * p.batch]
            pull = [0.0] * len(w)
            for i in rows:
                z = sign[i] * (sum(a * b for a, b in zip(w, x[i])) + w[-1])
                loss += weight[i] * (max(0, 1 - z) ** 2 if z >= -1 else -4 * z)
                slope = -2 * max(0, 1 - z) if z >= -1 else -4
                for j, v in enumerate([*x[i], 1.0]):
                    pull[j] += weight[i] * slope * sign[i] * v / len(rows)
            rate = 1 / (p.regParam * (first + epoch * steps + k))
            w = [v * (1 - rate * p.regParam) - rate * d for v, d in zip(w[:-1], pull)] + [w[-1] - rate * pull[-1]]
            mean = [m + (v - m) / (k + 1) for m, v in zip(mean, w)]
        loss /= n
        if best is None or loss < least:
            best = mean
        waited = 0 if loss < least - p.tol else waited + 1
        least = min(least, loss)
        w = w if waited < p.patience else w
        if waited >= p.patience:
            break
    return best


def test_linear_equals_the_plain_version(spark):
    x, y = labelled()
    df, columns = frame(spark, x, y)
    p = G.HuberParams(maxIter=12)
    got = G.fit_linear(df, columns, p)
    assert [*got.weights, got.bias] == pytest.approx(plain_linear(x, y, p), rel=1e-8)


@pytest.mark.parametrize("slice_rows", [1 << 16, 120])
def test_linear_scores_are_probabilities(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(gangs, "SLICE_ROWS", slice_rows)
    x, y = labelled()
    df, columns = frame(spark, x, y)
    scored = df.select("y", G.fit_linear(df, columns, G.HuberParams(maxIter=2000 if slice_rows > 1000 else 4)).probability().alias("score"))
    assert scored.where("score NOT BETWEEN 0 AND 1").count() == 0
    assert E.metrics(scored).first()["roc_auc"] > 0.95
    assert "Python" not in scored._jdf.queryExecution().toString()


def test_linear_odd_tables(spark):
    x, _ = labelled(20)
    df, columns = frame(spark, x)
    alone = G.fit_linear(df, columns, G.HuberParams(maxIter=5))
    assert df.select(alone.probability().alias("s")).where("s > 0.5").count() == 0  # one class
    empty, columns = frame(spark, x[:0])
    assert G.fit_linear(empty, columns).bias == 0.0


def test_network_gradients():
    rng = np.random.default_rng(1)
    p = G.NetworkParams(k=2)
    sizes, x = G._sizes(3, p), rng.normal(size=(5, 3))
    w = G.start(3, p)
    got = G._flat(G.gradients(G._layers(w, sizes), x))
    loss = lambda w: 0.5 * ((G.forward(G._layers(w, sizes), x)[-1] - x) ** 2).sum()
    for j in range(len(w)):
        step = np.zeros(len(w))
        step[j] = 1e-6
        assert got[j] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=1e-5)


def curved(n=1500):
    """Rows on a curved sheet, a few off it: as near to the best plane as the others."""
    rng = np.random.default_rng(4)
    u, v = rng.uniform(-1, 1, n), rng.uniform(-1, 1, n)
    x = np.column_stack([u, v, u * u, u * v, np.sin(2 * v), np.abs(u)]) * 2
    y = (np.arange(n) % 30 == 0).astype(int)
    x[y == 1] = rng.permuted(x[y == 1], axis=0)
    return (x - x.mean(0)) / x.std(0), y


@pytest.mark.parametrize("slice_rows", [1 << 16, 500])
def test_network_beats_a_plane_on_a_curved_sheet(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(gangs, "SLICE_ROWS", slice_rows)
    x, y = curved()
    df, columns = frame(spark, x, y)
    good = df.where("y = 0")
    p = G.NetworkParams(k=3, stepSize=5e-3, maxIter=100 if slice_rows > 1000 else 25, batch=50)
    network = G.fit_network(good, columns, p)
    start = G.Network(columns, G._layers(G.start(6, p), G._sizes(6, p)))
    assert network.error(x[y == 0]).mean() < 0.3 * start.error(x[y == 0]).mean()
    basis = np.linalg.svd(x[y == 0], full_matrices=False)[2][:3]
    flat = ((x - x @ basis.T @ basis) ** 2).mean(1)
    rows = spark.createDataFrame([(int(t), float(s)) for t, s in zip(y, flat)], "y int, score double")
    plane = E.metrics(rows).first()["pr_auc"]
    ours = E.metrics(df.select("y", network.column(F.array(*columns)).alias("score"))).first()["pr_auc"]
    assert ours >= plane or slice_rows < 1000


def test_network_odd_tables(spark):
    x, _ = labelled(3)
    df, columns = frame(spark, x)
    assert np.isfinite(G.fit_network(df, columns, G.NetworkParams(maxIter=2)).error(x)).all()
    empty, columns = frame(spark, x[:0])
    assert len(G.fit_network(empty, columns).layers) == 3
