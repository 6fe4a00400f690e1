"""Exact k-means with heap-ordered bounds: only vectors whose gap expires are looked at again.

Vectors lie in stored blocks. In a block every cluster keeps a binary heap of
(key, vector). When a vector is assigned, its gap is the distance to the second
nearest centroid less the distance to the nearest, and its key is that gap plus
the drift its cluster has accumulated so far. After a round, the drift of a
cluster grows by its own centroid's move plus the largest move of any other. A
vector can change hands only when the drift has eaten its gap, so keys below the
cluster's drift are popped, those vectors are compared with all centroids again
in exact integers, and pushed back under a new key. All others stay unread.

A round is one pass over the blocks. It stores the new heaps beside the vectors
and, once per task, how much the componentwise sums of each cluster changed;
Spark adds these up and k times length numbers come to the driver. Keys are
lowered by the rounding of their arithmetic, so a pop comes too early at worst,
and a tie is always popped. The assignment is that of plain k-means.

Cases: vectors that are null, hold a null or a non-finite component or have
another length take no part. Components beyond 2^27 in size are held there, so
that a distance fits a long; sums of distances beyond a long are held at its end.
The first centroids are the vectors of smallest key; a null id comes last, and
rows that repeat an id are ordered by their vectors. With fewer vectors than
centroids every vector starts one. Equal vectors start equal centroids: the
smaller number takes all, the other stays empty and where it is. Repeated rows
count as often as they occur. An empty table gives no rows. Only the id and the
vector are read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import narrow
from ledgerloom.llm.vectors import finite, scaled
from ledgerloom.session import pin, unpin

_LIMIT = 1 << 27
_BLOCK = 4096  # vectors
_STATE = "ids array<bigint>, whole binary, cluster binary, keys binary, places binary, sizes array<int>, sums array<bigint>, counts array<bigint>, scans bigint"


def _packed(x: np.ndarray) -> bytes:
    """In 16 bits if all numbers fit, else in 32."""
    return x.astype("<i2" if -(1 << 15) <= x.min(initial=0) and x.max(initial=0) < 1 << 15 else "<i4").tobytes()


def _unpacked(data: bytes, n: int, length: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i2" if len(data) == 2 * n * length else "<i4").reshape(n, length)


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    x, c = x.astype(np.int64), centroids.astype(np.int64)
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * (2 * largest) ** 2 < 2**52:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (smaller number on ties) and the gap to the second nearest, rounded down."""
    d = _squares(x, centroids)
    at = d.argmin(1)
    if d.shape[1] == 1:
        return at, np.full(len(x), np.inf)
    near, second = np.partition(d, 1, axis=1)[:, :2].T
    near, second = np.sqrt(near.astype(np.float64)), np.sqrt(second.astype(np.float64))
    return at, second - near - 1e-9 * second


class _Heaps:
    """A block's heaps, one per cluster, as lists of (key, place)."""

    def __init__(self, k: int, state: dict | None = None):
        self.of = [[] for _ in range(k)]
        if state:
            keys, places = np.frombuffer(state["keys"]).tolist(), np.frombuffer(state["places"], dtype="<i4").tolist()
            at = 0
            for c, n in enumerate(state["sizes"]):  # stored in heap order, so each list is a heap again
                self.of[c] = list(zip(keys[at : at + n], places[at : at + n]))
                at += n

    def expired(self, drift: np.ndarray) -> np.ndarray:
        out = []
        for heap, limit in zip(self.of, drift.tolist()):
            while heap and heap[0][0] <= limit:
                out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), dtype=np.int64)

    def push(self, places: np.ndarray, clusters: np.ndarray, keys: np.ndarray) -> None:
        for p, c, key in zip(places.tolist(), clusters.tolist(), keys.tolist()):
            heapq.heappush(self.of[c], (key, p))

    def stored(self) -> tuple[bytes, bytes, list[int]]:
        entries = [e for heap in self.of for e in heap]
        return np.array([e[0] for e in entries]).tobytes(), np.array([e[1] for e in entries], dtype="<i4").tobytes(), [len(h) for h in self.of]


def _row(ids, whole, cluster, heaps: _Heaps, scans: int, sums=None, counts=None) -> pa.RecordBatch:
    keys, places, sizes = heaps.stored()
    values = [ids, whole, cluster.astype("<i4").tobytes(), keys, places, sizes, sums, counts, scans]
    kinds = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], _NAMES)


_NAMES = [f.split()[0] for f in _STATE.split(", ")]


def _blocks(rows: DataFrame) -> DataFrame:
    """Stored blocks ``ids, whole`` of kept vectors ``vec_id, v`` (packed integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packed = [], []

        def flush() -> pa.RecordBatch:
            whole = _packed(np.frombuffer(b"".join(packed), dtype="<i4"))
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([whole], pa.binary())], ["ids", "whole"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                packed.append(v)
                if len(ids) == _BLOCK:
                    yield flush()
                    ids, packed = [], []
        if ids:
            yield flush()

    return pin(rows.select("vec_id", "v").mapInArrow(run, "ids array<bigint>, whole binary"), "blocks")


def _kept(table: DataFrame, id: str, vector: str, length: int, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, sizes, values = finite(batch.column(1), length)
            whole = scaled(values, scale, _LIMIT).reshape(len(places), length)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array([r.tobytes() for r in whole], pa.binary())], ["vec_id", "v"])

    rows = narrow(table, vec_id=id, vector=vector).select(F.col("vec_id").cast("long"), "vector")
    return rows.mapInArrow(run, "vec_id long, v binary")


def _round(blocks: DataFrame, centroids: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """One pass: pops what expired (all, if there are no heaps yet), rescans it and keeps the rest."""
    k, length = centroids.shape
    sent = blocks.sparkSession.sparkContext.broadcast((centroids, drift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, drift = sent.value
        sums, counts, held = np.zeros((k, length), dtype=np.int64), np.zeros(k, dtype=np.int64), None
        for batch in batches:
            for r in batch.to_pylist():
                if held is not None:
                    yield _row(*held)
                x = _unpacked(r["whole"], len(r["ids"]), length)
                if drift is None:
                    heaps, todo, cluster = _Heaps(k), np.arange(len(x)), np.full(len(x), -1)
                else:
                    heaps, cluster = _Heaps(k, r), np.frombuffer(r["cluster"], dtype="<i4").astype(np.int64)
                    todo = heaps.expired(drift)
                at, gap = _nearest(x[todo], centroids) if len(todo) else (todo, np.empty(0))
                heaps.push(todo, at, gap + (0.0 if drift is None else drift[at]))
                moved = at != cluster[todo]
                old, new, rows = cluster[todo][moved], at[moved], x[todo][moved].astype(np.int64)
                np.add.at(sums, new, rows)
                np.add.at(counts, new, 1)
                left = old >= 0
                np.subtract.at(sums, old[left], rows[left])
                np.subtract.at(counts, old[left], 1)
                cluster[todo] = at
                held = (r["ids"], r["whole"], cluster, heaps, len(todo))
        if held is not None:
            yield _row(*held, sums.ravel().tolist(), counts.tolist())

    return pin(blocks.mapInArrow(run, _STATE), "heaps")


def _changes(state: DataFrame, column: str, size: int) -> list[int]:
    parts = state.filter(F.col(column).isNotNull()).select(F.posexplode(column).alias("pos", "v"))
    out = [0] * size
    for pos, v in parts.groupBy("pos").agg(F.sum(F.col("v").cast("decimal(38,0)"))).collect():
        out[pos] = int(v)
    return out


def _moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Growth of each cluster's drift: its own move and the largest move of another, rounded up."""
    move = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1))
    other = np.full(len(move), 0.0)
    if len(move) > 1:
        top = np.argsort(move)[::-1]
        other[:] = move[top[0]]
        other[top[0]] = move[top[1]]
    return (move + other) * (1 + 1e-9)


def cluster(
    table: DataFrame, first: Column, k: int = 40, rounds: int = 5, scale: int = 256, length: int = 64, id: str = "vec_id", vector: str = "embedding", counted: list | None = None
) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` (squared) of every kept vector, and the final centroids.

    ``first`` ranks the vectors that start the centroids (over ``vec_id``). ``counted`` gets, per pass, how many vectors were rescanned.
    """
    kept = _kept(table, id, vector, length, scale)
    start = kept.select("v", first.alias("first")).orderBy(F.asc_nulls_last("first"), "v").limit(k).collect()
    if not start:
        return kept.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
    centroids = np.stack([np.frombuffer(r["v"], dtype="<i4") for r in start]).astype(np.int64)
    state, drift, sums, counts = _blocks(kept), None, np.zeros(centroids.shape, dtype=object), [0] * len(centroids)
    for turn in range(rounds + 1):
        before, state = state, _round(state, centroids, drift)
        unpin(before)
        if counted is not None:
            counted.append(state.agg(F.sum("scans")).first()[0])
        if turn == rounds:
            break
        sums = sums + np.array(_changes(state, "sums", centroids.size), dtype=object).reshape(centroids.shape)
        counts = [a + b for a, b in zip(counts, _changes(state, "counts", len(centroids)))]
        moved = np.array([[int(s) // n for s in row] if n else old.tolist() for row, n, old in zip(sums, counts, centroids)], dtype=np.int64)
        drift = (0.0 if drift is None else drift) + _moves(centroids, moved)
        centroids = moved
    sent = kept.sparkSession.sparkContext.broadcast(centroids)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.frombuffer(r["cluster"], dtype="<i4")
                x = _unpacked(r["whole"], len(at), length).astype(np.int64)
                far = ((x - sent.value[at]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(at), pa.array(far)], ["vec_id", "cluster", "distance"])

    rows = state.select("ids", "whole", "cluster").mapInArrow(out, "vec_id long, cluster int, distance long")
    found = pin(rows, "clusters")
    unpin(state)
    return found, centroids.tolist()


def with_inertia(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds ``cluster_inertia, inertia`` (sums of distances) and ``centroid_sha256``; the joined table has one row per cluster."""
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    names = rows.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    per = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    held = lambda n: min(n, 2**63 - 1)
    sums = rows.sparkSession.createDataFrame([(c, held(n), held(sum(per.values()))) for c, n in per.items()], "cluster int, cluster_inertia long, inertia long")
    return rows.join(F.broadcast(sums.join(names, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
