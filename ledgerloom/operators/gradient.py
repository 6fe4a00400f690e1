"""Models trained by gradient steps: a linear classifier with modified Huber loss, and a reconstruction network.

Both train in a gang of tasks (``gangs``) on scaled columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import gangs

_WEIGHTS = "part int, weights array<double>"


def _row(part: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([weights.tolist()], pa.list_(pa.float64()))], ["part", "weights"])


# ------------------------------------------------------------------ linear, modified Huber
@dataclass(frozen=True)
class HuberParams:
    maxIter: int = 2000
    regParam: float = 1e-4
    batch: int = 32
    tol: float = 1e-3
    patience: int = 5
    seed: int = 42


@dataclass
class Linear:
    columns: list[str]
    weights: np.ndarray
    bias: float

    def probability(self) -> Column:
        """(clip(margin, -1, 1) + 1) / 2, a plain expression over the scaled columns."""
        margin = F.lit(float(self.bias))
        for c, w in zip(self.columns, self.weights):
            margin = margin + F.col(c) * F.lit(float(w))
        return (F.greatest(F.least(margin, F.lit(1.0)), F.lit(-1.0)) + 1.0) / 2.0


def huber(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Modified Huber loss at z = y * margin (y is -1 or 1), and its derivative by z."""
    inner = np.maximum(0.0, 1.0 - z)
    return np.where(z >= -1, inner**2, -4.0 * z), np.where(z >= -1, -2.0 * inner, -4.0)


def _first_time(alpha: float) -> float:
    """Where the step size 1 / (alpha * t) begins: at the size of a typical weight over the loss's slope there."""
    typical = np.sqrt(1.0 / np.sqrt(alpha))
    slope = abs(float(huber(np.array([-typical]))[1][0]))
    return 1.0 / (typical / max(1.0, slope) * alpha)


def huber_epoch(x: np.ndarray, sign: np.ndarray, weight: np.ndarray, w: np.ndarray, p: HuberParams, epoch: int, place: int) -> tuple[np.ndarray, np.ndarray, float]:
    """One pass of a slice from ``w`` (the bias is last): the last weights, their mean over the pass, and the summed loss on the way."""
    order = np.random.default_rng([p.seed, epoch, place]).permutation(len(x))
    steps = -(-len(x) // p.batch)
    t = _first_time(p.regParam) + epoch * steps
    w, mean, loss = w.copy(), np.zeros_like(w), 0.0
    for k in range(steps):
        rows = order[k * p.batch : (k + 1) * p.batch]
        margin = x[rows] @ w[:-1] + w[-1]
        each, slope = huber(sign[rows] * margin)
        loss += float(weight[rows] @ each)
        pull = weight[rows] * slope * sign[rows] / len(rows)
        rate = 1.0 / (p.regParam * (t + k))
        w[:-1] = w[:-1] * (1.0 - rate * p.regParam) - rate * (pull @ x[rows])
        w[-1] -= rate * pull.sum()
        mean += (w - mean) / (k + 1)
    return w, mean, loss


def fit_linear(scaled: DataFrame, columns: Sequence[str], p: HuberParams = HuberParams()) -> Linear:
    """Averaged stochastic gradient descent over (row_id, y, columns) with balanced class weights.

    In every epoch each slice makes a pass of its own from the shared weights; the
    results are averaged by rows. It ends when the loss has not fallen by ``tol`` for
    ``patience`` epochs, and the averaged weights of the best epoch are the model.
    """
    n, positives = scaled.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return Linear(list(columns), np.zeros(len(columns)), 0.0)
    tasks = gangs.size(scaled, n)

    def work(gang: gangs.Gang, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = gangs.matrix(batches, columns)
        weight = np.where(y == 1, n / (2.0 * max(positives, 1)), n / (2.0 * max(n - positives, 1)))
        w, best, least, waited = np.zeros(len(columns) + 1), None, np.inf, 0
        for epoch in range(p.maxIter):
            last, mean, loss = huber_epoch(x, 2 * y - 1, weight, w, p, epoch, gang.place)
            share = len(x) / n
            merged = gang.add(np.concatenate([last * share, mean * share, [loss / n]]))
            w, mean, loss = merged[: len(w)], merged[len(w) : -1], merged[-1]
            if best is None or loss < least:
                best = mean
            waited = 0 if loss < least - p.tol else waited + 1
            least = min(least, loss)
            if waited >= p.patience:
                break
        yield _row(0, best)

    found = np.array(gangs.train(scaled.select("row_id", "y", *columns), tasks, work, _WEIGHTS)[0]["weights"])
    return Linear(list(columns), found[:-1], float(found[-1]))


# ------------------------------------------------------------------ reconstruction network
@dataclass(frozen=True)
class NetworkParams:
    """``k`` units in the narrowest layer, twice as many before it."""

    k: int = 16
    maxIter: int = 400
    batch: int = 200
    stepSize: float = 1e-3
    regParam: float = 1e-4
    heldOut: int = 10  # one row in so many is held out
    tol: float = 1e-4
    patience: int = 10
    seed: int = 42


@dataclass
class Network:
    """Layers of (matrix, bias), rectified but for the last; it learns to give back what it gets."""

    columns: list[str]
    layers: list[tuple[np.ndarray, np.ndarray]]

    def error(self, x: np.ndarray) -> np.ndarray:
        return ((forward(self.layers, x)[-1] - x) ** 2).mean(1)

    def column(self, vector: Column) -> Column:
        """Mean squared reconstruction error of a column of arrays, in Arrow batches."""

        @F.pandas_udf("double")
        def error(vectors: pd.Series) -> pd.Series:
            return pd.Series(self.error(np.asarray(vectors.tolist(), dtype=np.float64).reshape(len(vectors), len(self.columns))))

        return error(vector)


def forward(layers: list, x: np.ndarray) -> list[np.ndarray]:
    out = [x]
    for i, (m, b) in enumerate(layers):
        x = x @ m + b
        if i < len(layers) - 1:
            x = np.maximum(x, 0.0)
        out.append(x)
    return out


def gradients(layers: list, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Summed over the rows: gradients of half the squared error, by layer."""
    values = forward(layers, x)
    delta, out = values[-1] - x, []
    for i in range(len(layers) - 1, -1, -1):
        out.append((values[i].T @ delta, delta.sum(0)))
        if i:
            delta = (delta @ layers[i][0].T) * (values[i] > 0)
    return out[::-1]


def _sizes(width: int, p: NetworkParams) -> list[int]:
    return [width, 2 * p.k, p.k, width]


def _flat(layers: list) -> np.ndarray:
    return np.concatenate([np.concatenate([m.ravel(), b]) for m, b in layers])


def _layers(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def start(width: int, p: NetworkParams) -> np.ndarray:
    rng, sizes = np.random.default_rng(p.seed), _sizes(width, p)
    limits = [np.sqrt(6.0 / (a + b)) for a, b in zip(sizes, sizes[1:])]
    return _flat([(rng.uniform(-r, r, (a, b)), rng.uniform(-r, r, b)) for r, a, b in zip(limits, sizes, sizes[1:])])


def fit_network(scaled: DataFrame, columns: Sequence[str], p: NetworkParams = NetworkParams()) -> Network:
    """Mini-batch training with moment estimates (Adam) over (row_id, columns).

    In every epoch each slice trains on its own batches from the shared weights and
    moments; these are averaged by rows. One row in ``heldOut``, by hash, is kept out;
    training ends when its error has not fallen by ``tol`` for ``patience``
    epochs, and the best weights are the model.
    """
    width, sizes = len(columns), _sizes(len(columns), p)
    rows = scaled.select("row_id", (F.pmod(F.xxhash64(F.lit(p.seed), F.col("row_id")), F.lit(p.heldOut)) == 0).cast("int").alias("y"), *columns)
    n = rows.count()
    if not n:
        return Network(list(columns), _layers(start(width, p), sizes))
    tasks = gangs.size(rows, n)

    def work(gang: gangs.Gang, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, out = gangs.matrix(batches, columns)
        held, x = x[out == 1], x[out == 0]
        n_held, n_own = gang.add(np.array([len(held), len(x)], dtype=float))
        if not n_held or not n_own:  # too few rows to keep any out
            held = x = np.concatenate([held, x])
            n_held = n_own = n_held + n_own
        state, steps = np.concatenate([start(width, p), np.zeros(2 * len(start(width, p)))]), 0.0
        best, least, waited = state, np.inf, 0
        for epoch in range(p.maxIter):
            order = np.random.default_rng([p.seed, epoch, gang.place]).permutation(len(x))
            w, first, second = (v.copy() for v in np.split(state, 3))
            for k in range(-(-len(x) // p.batch)):
                part = x[order[k * p.batch : (k + 1) * p.batch]]
                layers = _layers(w, sizes)
                pulls = [(gm + p.regParam * m, gb) for (m, _), (gm, gb) in zip(layers, gradients(layers, part))]
                g, time = _flat(pulls) / len(part), steps + k + 1
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                w -= p.stepSize * (first / (1 - 0.9**time)) / (np.sqrt(second / (1 - 0.999**time)) + 1e-8)
            share = len(x) / n_own
            merged = gang.add(np.concatenate([w * share, first * share, second * share, [share * -(-len(x) // p.batch)]]))
            state, steps = merged[:-1], steps + merged[-1]
            layers = _layers(state[: len(w)], sizes)
            loss = gang.add(np.array([((forward(layers, held)[-1] - held) ** 2).mean(1).sum()]))[0] / n_held
            waited = 0 if loss < least - p.tol else waited + 1
            if loss < least:
                best, least = state, loss
            if waited >= p.patience:
                break
        yield _row(0, best[: len(best) // 3])

    found = np.array(gangs.train(rows, tasks, work, _WEIGHTS)[0]["weights"])
    return Network(list(columns), _layers(found, sizes))
