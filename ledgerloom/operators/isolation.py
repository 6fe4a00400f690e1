"""Isolation forest: trees grown per group on hashed samples, rows scored in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: `length` is a leaf's depth over the expected depth of its tree's own sample.
NODES = "tree int, node int, feature int, threshold double, left int, right int, length double"


def expected_depth(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _samples(df: DataFrame, trees: int, per_tree: int, seed: int) -> DataFrame:
    """About `per_tree` rows for each tree, drawn by hash so that a rerun draws the same.

    Every row enters trees * per_tree / n samples on average, the fraction by a
    hashed draw, each time that of a hashed tree. This is sampling with
    replacement, the same at every table size.
    """
    share = trees * per_tree / max(df.count(), 1)
    whole, rest = int(share), share - int(share)
    span = 1 << 30
    draw = lambda salt, *more: F.xxhash64(F.lit(salt), *more, F.col("row_id"))
    copies = F.lit(whole) + (F.pmod(draw(seed), F.lit(span)) < F.lit(int(span * rest))).cast("int")
    drawn = df.withColumn("_copy", F.explode(F.filter(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))), lambda c: c <= copies)))
    return drawn.withColumn("tree", F.pmod(draw(seed + 1, F.col("_copy")), F.lit(trees)).cast("int")).drop("_copy")


def _grow(columns: Sequence[str], seed: int, max_depth: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = pdf.sort_values("row_id")[list(columns)].to_numpy(dtype=np.float64)
        rows, todo, count = [], [(0, np.arange(len(x)), 0)], 1
        norm = expected_depth(len(x)) or 1.0
        while todo:
            node, idx, depth = todo.pop()
            low, high = x[idx].min(0), x[idx].max(0)
            splittable = np.flatnonzero(high > low)
            if depth >= max_depth or len(idx) <= 1 or not len(splittable):
                rows.append((tree, node, -1, 0.0, -1, -1, (depth + expected_depth(len(idx))) / norm))
                continue
            f = int(rng.choice(splittable))
            cut = float(rng.uniform(low[f], high[f]))
            goes_left = x[idx, f] <= cut
            rows.append((tree, node, f, cut, count, count + 1, 0.0))
            todo += [(count, idx[goes_left], depth + 1), (count + 1, idx[~goes_left], depth + 1)]
            count += 2
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "length"])

    return grow


def fit(df: DataFrame, columns: Sequence[str], trees: int = 250, per_tree: int = 256, seed: int = 42) -> list[tuple[np.ndarray, ...]]:
    """Grow the trees on Spark and gather their nodes: at most 2 * sample size per tree."""
    sampled = _samples(df.select("row_id", *columns), trees, per_tree, seed)
    depth = int(np.ceil(np.log2(per_tree)))
    nodes = sampled.groupBy("tree").applyInPandas(_grow(columns, seed, depth), NODES).toPandas()
    forest = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        forest.append(tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "length")))
    return forest


_ROWS = 1 << 12  # rows that walk down together


def complete(feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree with all leaves on one level, node i above 2 i + 1 and 2 i + 2: features, thresholds, and lengths of the last level."""
    depth, level = 0, [0]
    while level := [int(c) for n in level if feature[n] >= 0 for c in (left[n], right[n])]:
        depth += 1
    own, cuts, ends = np.zeros((1 << depth) - 1, dtype=np.int64), np.full((1 << depth) - 1, np.inf), np.empty(1 << depth)
    todo = [(0, 0, depth)]
    while todo:
        node, at, below = todo.pop()
        if feature[node] < 0:  # both sides of what is filled in below lead to the same length
            first = ((at + 1) << below) - (1 << depth)
            ends[first : first + (1 << below)] = length[node]
            continue
        own[at], cuts[at] = feature[node], threshold[node]
        todo += [(int(left[node]), 2 * at + 1, below - 1), (int(right[node]), 2 * at + 2, below - 1)]
    return own, cuts, ends


def path_lengths(x: np.ndarray, forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum over the (complete) trees of the length of each row's leaf; a row goes left if its value is at most the threshold."""
    total = np.zeros(len(x))
    for a in range(0, len(x), _ROWS):
        part = np.ascontiguousarray(x[a : a + _ROWS])
        flat, rows = part.ravel(), np.arange(len(part)) * x.shape[1]
        for own, cuts, ends in forest:
            at = np.zeros(len(part), dtype=np.int64)
            for _ in range(len(ends).bit_length() - 1):
                right = ~(flat.take(own.take(at) + rows) <= cuts.take(at))
                at *= 2
                at += 1
                at += right
            total[a : a + _ROWS] += ends.take(at - (len(ends) - 1))
    return total


def score(
    df: DataFrame, columns: Sequence[str], forest: list[tuple[np.ndarray, ...]], name: str = "isolation_raw", keep: Sequence[str] = ("row_id",)
) -> DataFrame:
    """`keep` and the score 2 ** -(mean of path length / expected length of the tree's sample); higher is stranger."""
    shared = df.sparkSession.sparkContext.broadcast([complete(*tree) for tree in forest])
    keep, fields = list(keep), {f.name: f for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(np.float64)
            scores = pa.array(np.power(2.0, -path_lengths(x, shared.value) / max(len(shared.value), 1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], scores], [*keep, name])

    schema = T.StructType([*[fields[c] for c in keep], T.StructField(name, T.DoubleType())])
    return df.select(*dict.fromkeys([*keep, *columns])).mapInArrow(run, schema)
