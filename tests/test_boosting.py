"""The booster against a plain one that looks at every row, and its explanations against sums over all coalitions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import boosting as B

COLUMNS = ["a", "b", "c", "d"]


def table(spark, x, y):
    rows = [(i, int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "row_id long, y int, " + ", ".join(f"{c} double" for c in COLUMNS))


@pytest.fixture(scope="module")
def xy():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 4))
    x[:, 2] = x[:, 2] > 0.4
    x[:, 3] = rng.integers(0, 3, 700)
    y = (x[:, 0] * x[:, 1] + 0.4 * x[:, 3] + rng.normal(scale=0.3, size=700) > 0.9).astype(int)
    return x, y


def plain(x, y, bounds, p):
    """Trees as nested tuples (feature, threshold, left, right) or values; and the margins of the rows."""
    margin, trees = np.zeros(len(y)), []
    n, pos = len(y), y.sum()
    weight = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    strength = lambda g, h: max(abs(g) - p.l1, 0) ** 2 / (h + p.l2)
    for number in range(p.maxIter):
        chance = 1 / (1 + np.exp(-margin))
        g, h = weight * (chance - y), weight * chance * (1 - chance)
        features = list(range(x.shape[1]))
        if p.columnShare < 1:
            order = np.random.default_rng([p.seed, number]).permutation(x.shape[1])
            features = sorted(order[: max(1, round(p.columnShare * x.shape[1]))].tolist())

        def split(rows):
            found = []
            whole = strength(g[rows].sum(), h[rows].sum())
            for f in features:
                for t in bounds[f]:
                    left, right = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                    if min(len(left), len(right)) < p.minInstancesPerNode or min(h[left].sum(), h[right].sum()) < p.minHessian:
                        continue
                    gain = strength(g[left].sum(), h[left].sum()) + strength(g[right].sum(), h[right].sum()) - whole
                    found.append((gain, f, t, left, right))
            top = max((s[0] for s in found), default=0)
            return next((s for s in found if s[0] >= top * (1 - 1e-9)), None) if top > 1e-10 else None

        root = {"rows": np.arange(n)}
        root["split"] = split(root["rows"])
        leaves = [root]
        while len(leaves) < p.maxLeaves:
            ready = [leaf for leaf in leaves if leaf["split"]]
            if not ready:
                break
            best = max(ready, key=lambda leaf: leaf["split"][0])
            leaves = [leaf for leaf in leaves if leaf is not best]
            best["sides"] = [{"rows": rows, "split": split(rows)} for rows in best["split"][3:]]
            leaves += best["sides"]

        def made(node):
            if "sides" in node:
                return (node["split"][1], node["split"][2], made(node["sides"][0]), made(node["sides"][1]))
            rows = node["rows"]
            total = g[rows].sum()
            value = -np.sign(total) * max(abs(total) - p.l1, 0) / (h[rows].sum() + p.l2) * p.stepSize
            margin[rows] += value
            return value

        trees.append(made(root))
    return trees, margin


def nested(tree, node=0):
    if tree.left[node] < 0:
        return tree.value[node]
    return (int(tree.feature[node]), tree.threshold[node], nested(tree, tree.left[node]), nested(tree, tree.right[node]))


def same(a, b):
    if isinstance(a, tuple):
        return isinstance(b, tuple) and a[:2] == pytest.approx(b[:2]) and same(a[2], b[2]) and same(a[3], b[3])
    return a == pytest.approx(b, rel=1e-6, abs=1e-9)


def fitted(train, p, small):
    """A fit here, where the module's bounds can be set; the one on Spark is compared with it."""
    rows = train.orderBy("row_id").collect()
    bounds = B.edges(train, COLUMNS, p.maxBins)
    grower = B.Grower(B._codes(np.array([[r[c] for c in COLUMNS] for r in rows]), bounds), np.array([r["y"] for r in rows]), bounds, p)
    here = [grower.grow(i) for i in range(p.maxIter)]
    forest = B.fit(train, COLUMNS, p)
    assert all(same(nested(a), nested(b)) for a, b in zip(here, forest.trees))
    return B.Forest(COLUMNS, 0.0, here)


PARAMS = [
    B.Params(maxIter=7, maxLeaves=6, maxBins=16, stepSize=0.3),
    B.Params(maxIter=5, maxLeaves=12, maxBins=8, stepSize=0.2, l1=1.5, l2=3.0, minInstancesPerNode=9),
    B.Params(maxIter=6, maxLeaves=5, maxBins=8, columnShare=0.5, seed=3),
]


@pytest.mark.parametrize("p", PARAMS)
@pytest.mark.parametrize("small", [1 << 13, 0])
def test_equals_the_plain_booster(spark, xy, monkeypatch, p, small):
    """By both ways of summing a leaf, with rows in any order."""
    x, y = xy
    train = table(spark, x, y).repartition(3)
    monkeypatch.setattr(B, "_SMALL", small)
    forest = fitted(train, p, small)
    trees, margin = plain(x, y, B.edges(train, COLUMNS, p.maxBins), p)
    assert len(forest.trees) == p.maxIter
    assert all(same(a, nested(b)) for a, b in zip(trees, forest.trees))
    got = {r["row_id"]: r["score"] for r in B.score(train, forest).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(list(1 / (1 + np.exp(-margin))), abs=1e-9)


def test_folds_equal_single_fits(spark, xy):
    x, y = xy
    train = table(spark, x, y)
    spans = spark.createDataFrame([(0, 300, 499), (1, 500, 699)], "fold int, first long, last long")
    trials = {"u": PARAMS[0], "v": B.Params(maxIter=4, maxLeaves=9, maxBins=16, l2=1.0)}
    got = {(r["model"], r["fold"], r["row_id"]): (r["y"], r["score"]) for r in B.fold_scores(train, COLUMNS, trials, spans).collect()}
    assert len(got) == 2 * 400
    bounds = B.edges(train, COLUMNS, 16)
    for name, p in trials.items():
        for fold, first, last in ((0, 300, 499), (1, 500, 699)):
            trees, _ = plain(x[:first], y[:first], bounds, p)
            for i in range(first, last + 1):
                margin = sum(leaf(t, x[i]) for t in trees)
                assert got[name, fold, i] == (y[i], pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9))
    with pytest.raises(ValueError):
        B.fold_scores(train, COLUMNS, trials, spans, most_rows=699)


def leaf(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def expected(tree, row, known, node=0):
    """Value of a tree if only some features are known: the others follow the training rows."""
    if tree.left[node] < 0:
        return tree.value[node]
    f, sides = tree.feature[node], (tree.left[node], tree.right[node])
    if f in known:
        return expected(tree, row, known, sides[0] if row[f] <= tree.threshold[node] else sides[1])
    return sum(tree.cover[s] * expected(tree, row, known, s) for s in sides) / tree.cover[node]


def shapley(trees, row):
    m = len(row)
    out = np.zeros(m)
    worth = lambda s: sum(expected(t, row, s) for t in trees)
    for f in range(m):
        others = [o for o in range(m) if o != f]
        for size in range(m):
            for s in combinations(others, size):
                out[f] += factorial(size) * factorial(m - size - 1) / factorial(m) * (worth({*s, f}) - worth(set(s)))
    return out, worth(set())


def test_shap_values_are_shapley_values(spark, xy):
    x, y = xy
    train = table(spark, x, y)
    forest = B.fit(train, COLUMNS, B.Params(maxIter=6, maxLeaves=14, maxBins=32, stepSize=0.4, minInstancesPerNode=3))
    found, bias = B.contributions(train.where("row_id < 60"), forest)
    rows = found.collect()
    assert len(rows) == 60
    for r in rows:
        want, base = shapley(forest.trees, x[r["row_id"]])
        got = np.zeros(4)
        got[r["places"]] = r["sizes"]
        assert got == pytest.approx(want, abs=1e-9)
        assert bias == pytest.approx(base, abs=1e-9)
        assert r["log_odds"] == pytest.approx(forest.log_odds(x[[r["row_id"]]])[0], abs=1e-9)


def test_odd_tables(spark, xy):
    x, y = xy
    empty = table(spark, x[:0], y[:0])
    assert B.fit(empty, COLUMNS).trees == []
    one = B.fit(table(spark, x[:50], np.zeros(50)), COLUMNS, B.Params(maxIter=3))
    assert B.score(table(spark, x[:5], y[:5]), one).where("score > 0.5").count() == 0
    holes = table(spark, x, y).withColumn("b", F.when(F.col("row_id") % 7 > 0, F.col("b")))
    forest = B.fit(holes, COLUMNS, B.Params(maxIter=3))
    assert B.score(holes, forest).where("score IS NULL OR isnan(score)").count() == 0


def test_importances(spark, xy):
    forest = B.fit(table(spark, *xy), COLUMNS, B.Params(maxIter=20))
    shares = dict(zip(COLUMNS, forest.importances()))
    assert sum(shares.values()) == pytest.approx(1) and shares["c"] == min(shares.values())


def test_windows_are_bounded(spark, xy):
    with pytest.raises(ValueError):
        B.fit(table(spark, *xy), COLUMNS, most_rows=699)
