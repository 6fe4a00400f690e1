"""Gradient boosted trees on histograms: leaf-wise growth, both penalties, column share, exact SHAP values.

Features are binned once to small codes; edges are quantiles that one Spark
aggregate finds over the whole training window, and the codes are stored. A tree
grows from sums of gradients, Hessians and rows per (leaf, feature, bin). Of two
sibling leaves only the smaller is summed, the larger is the parent less its
sibling. Features of two bins are summed by one matrix product.

A training window is bounded (``MOST_ROWS``, the bound of
``learning.training_split``; more rows are an error), so one fit is one task's work:
two bytes per value, about 120 MB in all at the bound. Many fits (folds x trials) are
one Spark stage over shared codes, every (trial, fold) a task. Exchanging sums
between tasks for every split was tried instead: at the bound a split's sums take
milliseconds, one barrier a second.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import pin, unpin

#: Rows of a training window.
MOST_ROWS = 600_000
_SMALL = 1 << 12  # rows up to which a leaf is summed in one pass over all features
_BITS = 10  # features of two bins that share a column
_SHAP_CELLS = 1 << 18  # rows x leaves of a block of explanations
_SHAP_ROWS = 1 << 13  # rows that look up their contributions together


@dataclass(frozen=True)
class Params:
    maxIter: int = 300
    stepSize: float = 0.05
    maxLeaves: int = 31
    minInstancesPerNode: int = 20
    l1: float = 0.0
    l2: float = 0.0
    columnShare: float = 1.0
    maxBins: int = 64
    minHessian: float = 1e-3
    seed: int = 42


@dataclass
class Tree:
    """Nodes in order of creation; ``left`` is -1 in leaves. A row goes left if its value is at most the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at, every = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        inner = self.left[at] >= 0
        while inner.any():
            f = np.maximum(self.feature[at], 0)
            at = np.where(inner, np.where(x[every, f] <= self.threshold[at], self.left[at], self.right[at]), at)
            inner = self.left[at] >= 0
        return at


class Lookup:
    """The trees of a forest as tables of leaf sets, for scoring many rows.

    A row's value of a feature is coded by its place among all the forest's thresholds on it. Per tree and feature a
    table gives the leaves that such a code leaves open, as bits; the row's leaf is the one open by all features.
    """

    ROWS = 1 << 13

    def __init__(self, trees: list[Tree]):
        split = [(int(f), float(t)) for tree in trees for f, t, left in zip(tree.feature, tree.threshold, tree.left) if left >= 0]
        self.bounds = {f: np.unique([t for g, t in split if g == f]) for f in sorted({f for f, _ in split})}
        self.trees = [self._tables(tree) for tree in trees]

    @staticmethod
    def fits(trees: list[Tree]) -> bool:
        return all((tree.left < 0).sum() <= 64 for tree in trees)

    def _tables(self, tree: Tree) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        leaves = np.flatnonzero(tree.left < 0)
        under = np.zeros(len(tree.left), dtype=np.uint64)
        under[leaves] = np.uint64(1) << np.arange(len(leaves), dtype=np.uint64)
        inner = np.flatnonzero(tree.left >= 0)
        for n in inner[::-1]:  # children come after their parent
            under[n] = under[tree.left[n]] | under[tree.right[n]]
        tables = {}
        for n in inner:
            f = int(tree.feature[n])
            table = tables.setdefault(f, np.full(len(self.bounds[f]) + 1, under[0], dtype=np.uint64))
            place = int(np.searchsorted(self.bounds[f], tree.threshold[n]))
            table[: place + 1] &= ~under[tree.right[n]]
            table[place + 1 :] &= ~under[tree.left[n]]
        return list(tables.items()), tree.value[leaves]

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        """Adds each row's leaf values to ``out``, tree by tree."""
        for at in range(0, len(x), self.ROWS):
            part, own = x[at : at + self.ROWS], out[at : at + self.ROWS]
            codes = {f: np.searchsorted(b, part[:, f], side="left") for f, b in self.bounds.items()}
            for tables, values in self.trees:
                if not tables:
                    own += values[0]
                    continue
                open_ = tables[0][1].take(codes[tables[0][0]])
                for f, table in tables[1:]:
                    open_ &= table.take(codes[f])
                own += values.take(np.bitwise_count(open_ - np.uint64(1)))


@dataclass
class Forest:
    """A fitted booster: log-odds are ``start`` plus the trees' leaf values."""

    columns: list[str]
    start: float
    trees: list[Tree] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if Lookup.fits(self.trees):
            known = self.__dict__.get("_lookup")
            if known is None or len(known.trees) != len(self.trees):
                known = self._lookup = Lookup(self.trees)
            known.add(x, out)
        else:
            for tree in self.trees:
                out += tree.value[tree.leaf_of(x)]
        return out

    def importances(self) -> np.ndarray:
        """Summed gains of the splits on each feature, as shares."""
        out = np.zeros(len(self.columns))
        for tree in self.trees:
            inner = tree.left >= 0
            np.add.at(out, tree.feature[inner], tree.gain[inner])
        return out / max(out.sum(), 1e-300)


# ------------------------------------------------------------------ binning
def edges(train: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper bounds of the bins of each column: its distinct values if they are few, else quantiles."""
    shares = [i / bins for i in range(1, bins)]
    kinds = train.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    many = [c for c in columns if kinds[c] > bins // 2]
    rest = [c for c in columns if c not in many]
    got = train.agg(
        *[F.percentile_approx(c, shares, 10_000).alias(c) for c in many], *[F.array_sort(F.collect_set(c)).alias(c) for c in rest]
    ).first()
    out = []
    for c in columns:
        values = np.unique(np.array(got[c] or [], dtype=np.float64))
        out.append(values[:-1] if c in rest else values)  # the last bin has no upper bound
    return out


def _codes(x: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """Codes of all features side by side: each feature's bins come after those of the feature before."""
    out = np.empty(x.shape, dtype=np.uint16)
    at = 0
    for f, b in enumerate(bounds):
        out[:, f] = np.searchsorted(b, x[:, f], side="left") + at
        at += len(b) + 1
    return out


def binned(train: DataFrame, columns: Sequence[str], bounds: list[np.ndarray], order: str = "row_id") -> DataFrame:
    """Stored ``row_id, y, codes``."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(np.float64)
            packed = [row.tobytes() for row in _codes(np.nan_to_num(x), bounds)]
            yield pa.RecordBatch.from_arrays([batch.column(order), batch.column("y"), pa.array(packed, pa.binary())], ["row_id", "y", "codes"])

    rows = train.select(order, F.col("y").cast("int"), *names)
    return pin(rows.mapInArrow(run, "row_id long, y int, codes binary"), "codes")


# ------------------------------------------------------------------ growing
class Grower:
    """Grows trees over the coded rows of a training window."""

    def __init__(self, codes: np.ndarray, y: np.ndarray, bounds: list[np.ndarray], p: Params):
        self.codes, self.bounds, self.p = np.asfortranarray(codes), bounds, p
        self.y, self.weight = y.astype(np.float64), balanced(y, len(y), y.sum())
        sizes = np.array([len(b) + 1 for b in bounds])
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.total = int(self.ends[-1])
        self.feature_of = np.repeat(np.arange(len(sizes)), sizes)
        self.splits = np.ones(self.total, dtype=bool)
        self.splits[self.ends - 1] = False  # nothing is right of a last bin
        # columns to sum over: each feature of more bins, and the two-bin features in groups, as bit patterns
        wide, pairs = np.flatnonzero(sizes != 2), np.flatnonzero(sizes == 2)
        columns = [codes[:, f] - self.begins[f].astype(np.uint16) for f in wide]
        widths, self.groups = [int(sizes[f]) for f in wide], []
        for at in range(0, len(pairs), _BITS):
            own = pairs[at : at + _BITS]
            bits = (codes[:, own] - self.begins[own].astype(np.uint16)).astype(np.uint16)
            columns.append((bits << np.arange(len(own), dtype=np.uint16)).sum(1, dtype=np.uint16))
            self.groups.append((own, (np.arange(1 << len(own))[:, None] >> np.arange(len(own)) & 1).astype(np.float64)))
            widths.append(1 << len(own))
        self.columns = [np.ascontiguousarray(c) for c in columns]
        self.starts = np.concatenate([[0], np.cumsum(widths)])
        self.flat = np.column_stack(self.columns).astype(np.int64) + self.starts[:-1]
        self.of_wide = np.concatenate([np.arange(self.begins[f], self.ends[f]) for f in wide]) if len(wide) else np.empty(0, dtype=np.int64)
        self.members = [*[[f] for f in wide], *[own for own, _ in self.groups]]
        self.active, self.narrow, self.first = list(range(len(self.columns))), self.flat, 0
        self.margin = np.zeros(len(y))

    def sums(self, rows: np.ndarray | None, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Gradients, Hessians and rows per code of a leaf (of all rows, if none are named)."""
        if rows is not None:
            g, h = g.take(rows), h.take(rows)
        found, total = np.zeros((3, self.starts[-1])), self.starts[-1]
        if len(g) <= _SMALL:
            flat, width = (self.narrow if rows is None else self.narrow[rows]).ravel(), len(self.active)
            found[0], found[1] = np.bincount(flat, np.repeat(g, width), total), np.bincount(flat, np.repeat(h, width), total)
            found[2] = np.bincount(flat, minlength=total)
        else:
            for c in self.active:
                column, a, b = self.columns[c] if rows is None else self.columns[c].take(rows), self.starts[c], self.starts[c + 1]
                found[0, a:b], found[1, a:b] = np.bincount(column, g, b - a), np.bincount(column, h, b - a)
                found[2, a:b] = np.bincount(column, minlength=b - a)
        if not self.groups:
            return found
        out = np.empty((3, self.total))
        out[:, self.of_wide] = found[:, : len(self.of_wide)]
        for (own, patterns), a in zip(self.groups, self.starts[len(self.columns) - len(self.groups) :]):
            part = found[:, a : a + len(patterns)]
            right = part @ patterns
            out[:, self.begins[own] + 1], out[:, self.begins[own]] = right, part.sum(1)[:, None] - right
        return out

    def best(self, sums: np.ndarray, places: np.ndarray) -> list[tuple[float, int]]:
        """Of each leaf (leaf, sum, code): gain and place (the last code that goes left) of its best split among ``places``."""
        p = self.p
        left = np.cumsum(sums, axis=2)
        before = left[:, :, self.begins] - sums[:, :, self.begins]
        whole = (left[:, :, self.ends[self.first] - 1] - before[:, :, self.first])[:, :, None]
        left = left[:, :, places] - before[:, :, self.feature_of[places]]
        right = whole - left
        ok = (np.minimum(left[:, 2], right[:, 2]) >= p.minInstancesPerNode) & (np.minimum(left[:, 1], right[:, 1]) >= p.minHessian)
        gain = np.where(ok, self._strength(left) + self._strength(right) - self._strength(whole), 0.0)
        out = []
        for row, top in zip(gain, gain.max(1).tolist()):
            at = int((row >= top * (1 - 1e-9)).argmax())  # the first of equals, whatever rounding did to them
            out.append((float(row[at]), int(places[at])) if top > 1e-10 else (0.0, -1))
        return out

    def _strength(self, s: np.ndarray) -> np.ndarray:
        """Of sums (leaf, sum, code)."""
        return np.maximum(np.abs(s[:, 0]) - self.p.l1, 0.0) ** 2 / (s[:, 1] + self.p.l2 + 1e-15)

    def grow(self, number: int) -> Tree:
        """One tree, best leaf first, on the gradients of now; adds its values to the margins."""
        p = self.p
        chance = 1.0 / (1.0 + np.exp(-self.margin))
        g, h = self.weight * (chance - self.y), self.weight * chance * (1.0 - chance)
        allowed = self.splits
        if p.columnShare < 1:
            many = max(1, int(round(p.columnShare * len(self.bounds))))
            chosen = np.random.default_rng([p.seed, number]).permutation(len(self.bounds))[:many]
            allowed = allowed & np.isin(self.feature_of, chosen)
            self.active, self.first = [c for c, own in enumerate(self.members) if np.isin(own, chosen).any()], int(chosen.min())
            self.narrow = self.flat[:, self.active]  # other features are not summed
        places = np.flatnonzero(allowed)
        feature, threshold, left, right, gains = [-1], [0.0], [-1], [-1], [0.0]
        rows, sums = [np.arange(len(self.y))], [self.sums(None, g, h)]
        splits = self.best(sums[0][None], places) if len(places) else [(0.0, -1)]
        leaves = {0}
        while len(leaves) < p.maxLeaves:
            top = max(leaves, key=lambda n: (splits[n][0], -n))
            gain, code = splits[top]
            if code < 0:
                break
            f = int(self.feature_of[code])
            feature[top], threshold[top], gains[top] = f, float(self.bounds[f][code - self.begins[f]]), gain
            left[top], right[top] = len(feature), len(feature) + 1
            goes_left = self.codes[:, f].take(rows[top]) <= code
            sides = [rows[top][goes_left], rows[top][~goes_left]]
            small = 0 if len(sides[0]) <= len(sides[1]) else 1
            part = self.sums(sides[small], g, h)
            both = [part, sums[top] - part]
            both = np.stack(both if small == 0 else both[::-1])
            splits += self.best(both, places)
            for side, own in zip(sides, both):
                leaves.add(len(feature))
                rows.append(side)
                sums.append(own)
                feature, threshold, left, right, gains = [*feature, -1], [*threshold, 0.0], [*left, -1], [*right, -1], [*gains, 0.0]
            leaves.remove(top)
            rows[top] = None
        own = slice(self.begins[self.first], self.ends[self.first])
        whole = np.stack([s[:, own].sum(1) for s in sums])
        value = -np.sign(whole[:, 0]) * np.maximum(np.abs(whole[:, 0]) - p.l1, 0.0) / (whole[:, 1] + p.l2 + 1e-15) * p.stepSize
        value[[n for n in range(len(value)) if n not in leaves]] = 0.0
        for n in leaves:
            self.margin[rows[n]] += value[n]
        return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), value, whole[:, 2], np.array(gains))


_TREE = "round int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, cover array<double>, gain array<double>"
_PARTS = ["feature", "threshold", "left", "right", "value", "cover", "gain"]
_KINDS = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]


def _tree_row(number: int, tree: Tree) -> pa.RecordBatch:
    columns = [pa.array([getattr(tree, c).tolist()], pa.list_(t)) for c, t in zip(_PARTS, _KINDS)]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *columns], ["round", *_PARTS])


def _tree_of(row) -> Tree:
    return Tree(*[np.array(row[c], dtype=np.int64 if c in ("feature", "left", "right") else np.float64) for c in _PARTS])


def _slice(batches: Iterator[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray]:
    labels, packed = [], []
    for batch in batches:
        labels.append(batch.column("y").to_numpy())
        packed += batch.column("codes").to_pylist()
    codes = np.frombuffer(b"".join(packed), dtype=np.uint16).reshape(-1, width)
    return codes, np.concatenate(labels) if labels else np.empty(0, dtype=np.int32)


def balanced(y: np.ndarray, rows: float, positives: float) -> np.ndarray:
    """n / (2 * n_class)."""
    return np.where(y == 1, rows / (2.0 * max(positives, 1.0)), rows / (2.0 * max(rows - positives, 1.0)))


def _checked(train: DataFrame, most_rows: int) -> int:
    rows = train.count()
    if rows > most_rows:
        raise ValueError(f"a training window holds at most {most_rows} rows, not {rows}")
    return rows


def fit(train: DataFrame, columns: Sequence[str], p: Params = Params(), most_rows: int = MOST_ROWS) -> Forest:
    """One booster over (row_id, y, columns) of a training window."""
    forest = Forest(list(columns), 0.0)
    if not _checked(train, most_rows):
        return forest
    bounds = edges(train, columns, p.maxBins)
    stored = binned(train, columns, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, y = _slice(batches, len(bounds))
        if len(y):
            grower = Grower(codes, y, bounds, p)
            for number in range(p.maxIter):
                yield _tree_row(number, grower.grow(number))

    grown = stored.coalesce(1).sortWithinPartitions("row_id").select("y", "codes").mapInArrow(run, _TREE).collect()  # rounds x leaves
    forest.trees = [_tree_of(r) for r in sorted(grown, key=lambda r: r["round"])]
    unpin(stored)
    return forest


def _leaf_by_code(tree: Tree, codes: np.ndarray, grower: Grower) -> np.ndarray:
    """As ``Tree.leaf_of``, by codes: a threshold is the upper bound of a bin."""
    cut = lambda f, t: grower.begins[f] + np.searchsorted(grower.bounds[f], t, side="left")
    limit = np.array([cut(f, t) if left >= 0 else 0 for f, t, left in zip(tree.feature, tree.threshold, tree.left)])
    at, every = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
    inner = tree.left[at] >= 0
    while inner.any():
        f = np.maximum(tree.feature[at], 0)
        at = np.where(inner, np.where(codes[every, f] <= limit[at], tree.left[at], tree.right[at]), at)
        inner = tree.left[at] >= 0
    return at


# ------------------------------------------------------------------ many fits
def fold_scores(train: DataFrame, columns: Sequence[str], trials: dict[str, Params], folds: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``model, fold, row_id, y, score`` of every trial on every fold: trained on all rows before the fold, scored inside it.

    ``train`` is a training window of at most ``most_rows`` (more is an error); its codes go to the tasks as one
    broadcast, two bytes per value, and every (trial, fold) is one task's fit.
    ``folds`` has ``fold, first, last``, the first and last ``row_id`` of each.
    """
    spark = train.sparkSession
    _checked(train, most_rows)
    most = max(p.maxBins for p in trials.values())
    bounds = edges(train, columns, most)
    stored = binned(train, columns, bounds)
    rows = stored.orderBy("row_id").toArrow()
    width = len(columns)
    codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), dtype=np.uint16).reshape(-1, width)
    spans = [(r["fold"], r["first"], r["last"]) for r in folds.select("fold", "first", "last").collect()]
    jobs = [(name, p, *span) for name, p in trials.items() for span in spans]
    jobs.sort(key=lambda j: -j[3] * (8 + j[1].maxLeaves / 8) * j[1].maxIter)  # the longest first, about
    sent = spark.sparkContext.broadcast((rows["row_id"].to_numpy(), rows["y"].to_numpy(), codes, bounds, jobs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, codes, bounds, jobs = sent.value
        for batch in batches:
            for name, p, fold, first, last in [jobs[i] for i in batch.column(0).to_pylist()]:
                early, block = ids < first, (ids >= first) & (ids <= last)
                own = codes[block]
                margin = np.zeros(len(own))
                if early.any():
                    grower = Grower(codes[early], y[early], bounds, p)
                    for number in range(p.maxIter):
                        tree = grower.grow(number)
                        margin += tree.value[_leaf_by_code(tree, own, grower)]
                n = len(margin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array([fold] * n, pa.int32()), pa.array(ids[block], pa.int64()), pa.array(y[block], pa.int32()),
                     pa.array(1.0 / (1.0 + np.exp(-margin)))],
                    ["model", "fold", "row_id", "y", "score"],
                )

    out = pin(spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "model string, fold int, row_id long, y int, score double"), "fold-scores")
    sent.unpersist()
    unpin(stored)
    return out


# ------------------------------------------------------------------ scoring and explaining
def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.nan_to_num(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(np.float64))


def score(df: DataFrame, forest: Forest, name: str = "score", keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """``keep`` and the probability."""
    sent = df.sparkSession.sparkContext.broadcast(forest)
    keep, fields = list(keep), {f.name: f for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = 1.0 / (1.0 + np.exp(-sent.value.log_odds(_matrix(batch, sent.value.columns))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(chance)], [*keep, name])

    schema = T.StructType([*[fields[c] for c in keep], T.StructField(name, T.DoubleType())])
    return df.select(*dict.fromkeys([*keep, *forest.columns])).mapInArrow(run, schema)


class Paths:
    """The leaves of a tree as intervals per feature, for exact SHAP values.

    On the way to a leaf a feature bounds an interval; ``share`` is the part of
    the training rows that stays on the path at its splits (the product over
    them). A coalition of the features it knows keeps a row on the path if the
    row lies in those intervals, and the others let it pass with their shares.
    So the leaf's part of a feature's value is

        value * (inside - share) * sum over coalitions of the other features,

    and the Shapley weights of coalitions of one size are an integral over 0..1
    of t^size (1 - t)^(rest): the sum is the integral of the product over the
    other features of share * (1 - t) + inside * t, a polynomial in t, which a
    Gauss-Legendre rule with half as many nodes as features gives exactly.
    """

    def __init__(self, tree: Tree):
        found = []
        todo = [(0, {})]
        while todo:
            node, path = todo.pop()
            if tree.left[node] < 0:
                found.append((float(tree.value[node]), path))
                continue
            f, t = int(tree.feature[node]), float(tree.threshold[node])
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, lo, hi in ((tree.left[node], low, min(high, t)), (tree.right[node], max(low, t), high)):
                todo.append((int(child), {**path, f: (lo, hi, share * tree.cover[child] / tree.cover[node])}))
        depth = max(1, *(len(p) for _, p in found))
        self.value = np.array([v for v, _ in found])
        self.feature = np.zeros((len(found), depth), dtype=np.int64)
        self.low, self.high = np.full((len(found), depth), -np.inf), np.full((len(found), depth), np.inf)
        self.share = np.ones((len(found), depth))
        for i, (_, path) in enumerate(found):
            for j, (f, (lo, hi, share)) in enumerate(path.items()):
                self.feature[i, j], self.low[i, j], self.high[i, j], self.share[i, j] = f, lo, hi, share
        nodes, weights = np.polynomial.legendre.leggauss(-(-depth // 2))
        t, weight = (nodes + 1) / 2, weights / 2
        # a feature's factor at each node of the rule, outside and inside of its interval: (leaf, feature, node)
        outside = self.share[:, :, None] * (1 - t)
        inside = outside + t
        self.base, self.gain = np.log(outside).sum(1), np.log(inside) - np.log(outside)
        self.less, self.more = (weight / outside).transpose(0, 2, 1), (weight / inside - weight / outside).transpose(0, 2, 1)
        self.expected = float((self.value * self.share.prod(1)).sum())
        self.used = [len(path) for _, path in found]

    def tables(self) -> list[np.ndarray]:
        """Per leaf the contributions of the features on its path, by the pattern of those whose interval holds the row (feature, pattern)."""
        out = []
        for i, many in enumerate(self.used):
            inside = np.ones((1 << many, self.share.shape[1]))
            inside[:, :many] = np.arange(1 << many)[:, None] >> np.arange(many) & 1
            whole = np.exp(self.base[i] + inside @ self.gain[i])
            total = (whole @ self.less[i] + inside * (whole @ self.more[i])) * (inside - self.share[i]) * self.value[i]
            out.append(np.ascontiguousarray(total[:, :many].T))
        return out

    def add_many(self, x: np.ndarray, out: np.ndarray) -> None:
        """As ``add`` for many rows, both arrays by feature: a leaf's contributions depend on few patterns, so each is calculated once and looked up."""
        for i, table in enumerate(self.tables()):
            pattern = np.zeros(x.shape[1], dtype=np.int64)
            for j in range(self.used[i]):
                column = x[self.feature[i, j]]
                pattern |= ((column > self.low[i, j]) & (column <= self.high[i, j])).astype(np.int64) << j
            for j, part in enumerate(table):
                out[self.feature[i, j]] += part.take(pattern)

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        """Adds each row's contributions to ``out``.

        Whether a row is inside is 0 or 1, so products over features are sums of logarithms, and the product
        without one feature is divided by one of two factors: both are matrix products per leaf.
        """
        seen = x[:, self.feature].transpose(1, 0, 2)  # (leaf, row, feature)
        inside = ((seen > self.low[:, None]) & (seen <= self.high[:, None])).astype(np.float64)  # one where there is no feature: neutral
        whole = np.exp(self.base[:, None] + inside @ self.gain)
        total = (whole @ self.less + inside * (whole @ self.more)) * (inside - self.share[:, None]) * self.value[:, None, None]
        at = np.arange(len(x))[:, None] * out.shape[1] + self.feature[:, None, :]
        out += np.bincount(at.ravel(), total.ravel(), out.size).reshape(out.shape)


def shap(x: np.ndarray, paths: list[Paths]) -> np.ndarray:
    """Exact Shapley values of the log-odds, with training rows as cover weights."""
    out = np.zeros(x.shape)
    few = [p for p in paths if 8 << max(p.used) > len(x)]
    if len(few) < len(paths):
        for at in range(0, len(x), _SHAP_ROWS):
            columns = np.ascontiguousarray(x[at : at + _SHAP_ROWS].T)
            found = np.zeros(columns.shape)
            for p in paths:
                if 8 << max(p.used) <= len(x):
                    p.add_many(columns, found)
            out[at : at + _SHAP_ROWS] = found.T
    paths = few
    step = max(1, _SHAP_CELLS // max(1, max((p.feature.size for p in paths), default=1)))
    for at in range(0, len(x), step):
        part = out[at : at + step]
        for p in paths:
            p.add(x[at : at + step], part)
    return out


def contributions(df: DataFrame, forest: Forest) -> tuple[DataFrame, float]:
    """``row_id, log_odds, places, sizes``: features by falling size of their contribution; and the expected log-odds."""
    paths = [Paths(t) for t in forest.trees]
    bias = forest.start + sum(p.expected for p in paths)
    sent = df.sparkSession.sparkContext.broadcast(paths)
    columns = list(forest.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shap(_matrix(batch, columns), sent.value)
            order = np.argsort(-np.abs(values), axis=1, kind="stable")
            sizes = np.take_along_axis(values, order, axis=1)
            lists = lambda a, t: pa.array(list(a), pa.list_(t))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), pa.array(values.sum(1) + bias), lists(order, pa.int64()), lists(sizes, pa.float64())], ["row_id", "log_odds", "places", "sizes"]
            )

    rows = df.select(F.col("row_id").cast("long"), *columns)
    return rows.mapInArrow(run, "row_id long, log_odds double, places array<long>, sizes array<double>"), float(bias)
