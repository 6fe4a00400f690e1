"""Fast scoring gives the same bits as walking down the trees."""

import numpy as np
import pytest

from ledgerloom.operators import boosting, isolation


def grown(rng, leaves, width, cuts):
    """A random tree: leaves are split until there are so many."""
    feature, threshold, left, right, open_ = [-1], [0.0], [-1], [-1], [0]
    while len(open_) < leaves:
        n = open_.pop(int(rng.integers(len(open_))))
        feature[n], threshold[n] = int(rng.integers(width)), float(rng.choice(cuts))
        left[n], right[n] = len(feature), len(feature) + 1
        open_ += [left[n], right[n]]
        feature, threshold, left, right = [*feature, -1, -1], [*threshold, 0.0, 0.0], [*left, -1, -1], [*right, -1, -1]
    a = [np.array(v) for v in (feature, threshold, left, right)]
    return boosting.Tree(*a, np.where(a[2] < 0, rng.normal(size=len(left)), 0.0), np.ones(len(left)), np.zeros(len(left)))


def rows(rng, cuts, n, width):
    x = rng.choice([*cuts, *(rng.normal(size=20)), np.inf, -np.inf, np.nan], (n, width))
    return x


@pytest.mark.parametrize("leaves", [1, 2, 31, 64, 90])
def test_boosted_trees(leaves):
    rng = np.random.default_rng(leaves)
    cuts = rng.normal(size=12)
    x = rows(rng, cuts, 9000, 5)
    forest = boosting.Forest(list("abcde"), 0.25, [grown(rng, leaves, 5, cuts) for _ in range(20)])
    want = np.full(len(x), 0.25)
    for t in forest.trees:
        want += t.value[t.leaf_of(x)]
    assert boosting.Lookup.fits(forest.trees) == (leaves <= 64)
    assert np.array_equal(forest.log_odds(x), want)


@pytest.mark.parametrize("leaves", [1, 2, 40])
def test_isolation_trees(leaves):
    rng = np.random.default_rng(leaves)
    cuts = rng.normal(size=12)
    x = rows(rng, cuts, 9000, 5)
    trees = [grown(rng, leaves, 5, cuts) for _ in range(10)]
    want = np.zeros(len(x))
    for t in trees:
        want += t.value[t.leaf_of(x)]
    found = isolation.path_lengths(x, [isolation.complete(np.where(t.left < 0, -1, t.feature), t.threshold, t.left, t.right, t.value) for t in trees])
    assert np.array_equal(found, want)


@pytest.mark.parametrize("leaves", [1, 2, 16, 31])
def test_shap_tables(leaves):
    """Contributions looked up by pattern are those of the formula, in blocks and for few rows."""
    rng = np.random.default_rng(leaves)
    cuts = rng.normal(size=12)
    trees = [grown(rng, leaves, 6, cuts) for _ in range(4)]
    for t in trees:
        for n in reversed(np.flatnonzero(t.left >= 0)):
            t.cover[n] = t.cover[t.left[n]] + t.cover[t.right[n]]
    paths = [boosting.Paths(t) for t in trees]
    x = rng.choice([*cuts, *rng.normal(size=20)], (9000, 6))
    want = np.zeros(x.shape)
    for at in range(0, len(x), 500):
        for p in paths:
            p.add(x[at : at + 500], want[at : at + 500])
    assert np.allclose(boosting.shap(x, paths), want, rtol=1e-9, atol=1e-12)
    assert np.allclose(boosting.shap(x[:3], paths), want[:3], rtol=1e-9, atol=1e-12)
    if leaves > 2:
        assert all(8 << max(p.used) <= len(x) for p in paths)
