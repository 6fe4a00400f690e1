"""Exact top-k by inner product: vectors by falling length, rotated partial sums, residual bounds.

All vectors are dealt by falling length into rings (range partitions) of tiles
of about half a megabyte. Each is also stored rotated by the right singular
vectors of a sample, so that the first few components carry most of a product.
Queries search in waves, from the longest vectors down. A wave reads only tiles
whose longest vector could still reach a query's k-th best score (length times
length, Cauchy-Schwarz). Inside a tile the same bound ends a query's scan at the
first vector that is too short; then partial sums over the leading components
plus the product of the two residual lengths rule out most of the rest; what is
left gets its exact integer product. Thresholds of all waves before hold in the
next one, and waves grow fourfold, so their number is logarithmic.

The first wave is broadcast: at most ``_HEAD`` tiles. Later waves join query
tiles with vector tiles by tile number. Only one row per ring (at most 1024)
comes to the driver, and the bounded sample for the rotation (the vectors of
smallest hash, at most ``sample``). The rotation affects speed only: bounds are
widened by the rounding of their arithmetic and results are exact integers.

Cases: vectors that are null or hold a null or a non-finite component take no
part. Shorter vectors count as padded with zeros, an empty one as all zeros.
Components beyond 2^24 in size are held there, so that a product fits a long.
A null id is never a query and loses every tie. Rows that repeat an id stay
rows of their own: each is a candidate, and each is a query if its id is one;
only a query's own row is left out. Equal scores go to the smaller id. Fewer
candidates than k: all of them. An empty table gives no rows. Only the id and
the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import narrow
from ledgerloom.llm.vectors import finite, padded, scaled
from ledgerloom.session import pin, unpin

_LIMIT = 1 << 24
_TILE_BYTES = 1 << 19
_QUERIES = 256  # queries in a tile
_RINGS = 1024  # at most
_HEAD = 4  # tiles that the first wave broadcasts
_GROWTH = 4
_STEP = 1024  # vectors between two looks at the thresholds
_DENSE = 0.1  # share of survivors from which a whole block is multiplied
_TILE = "tile int, top double, rows array<bigint>, ids array<bigint>, whole binary, turned binary"
_FOUND = "qtile long, pos int, qrow long, query_id long, score long, vec_id long"


class _Block:
    """Some vectors: rows, ids, integers, the rotated ones, lengths, and residual lengths behind each cut."""

    def __init__(self, rows, ids, whole: bytes, turned: bytes, width: int, cuts: list[int]):
        self.rows = np.asarray(rows, dtype=np.int64)
        self.ids = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], dtype=np.int64)
        self.named = np.array([i is not None for i in ids], dtype=bool)
        self.whole = np.frombuffer(whole, dtype="<i4").reshape(len(self.rows), width).astype(np.float64)
        self.turned = np.frombuffer(turned, dtype="<f4").reshape(len(self.rows), width)
        self.lengths = np.sqrt((self.whole**2).sum(1))
        squares = np.cumsum(self.turned[:, ::-1].astype(np.float64) ** 2, axis=1)[:, ::-1]
        self.rest = {c: np.sqrt(squares[:, c]) if c < width else np.zeros(len(self.rows)) for c in cuts}


def _exact(a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """Integer products of all rows of ``a`` with all of ``b``: by doubles while every partial sum is exact in them."""
    if reach < 2**53:
        return a @ b.T
    return (a.astype(np.int64) @ b.astype(np.int64).T).astype(np.longdouble)


def _pair(q: _Block, x: _Block, least: np.ndarray, k: int, cuts: list[int], seen: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, vector places and scores that can be among the k best; ``least`` is each query's threshold so far."""
    width = q.whole.shape[1]
    kind = np.float64 if q.lengths.max() * x.lengths.max() < 2**53 else np.longdouble
    best, least = np.full((len(q.rows), k), -np.inf, dtype=kind), least.astype(kind)
    found = []
    for lo in range(0, len(x.rows), _STEP):
        hi = min(lo + _STEP, len(x.rows))
        reach = q.lengths[:, None] * x.lengths[None, lo:hi]
        slack = reach * ((width + 8) * 2.0**-22)  # rounding of 32-bit sums and of a rotation held in 32 bits
        alive = ~(reach + slack < least[:, None])
        if not alive.any():
            break  # all that follow are shorter
        for cut in cuts:
            if np.isneginf(least).all():
                break
            part = q.turned[:, :cut] @ x.turned[lo:hi, :cut].T
            alive &= ~(part + q.rest[cut][:, None] * x.rest[cut][None, lo:hi] + slack < least[:, None])
            if not alive.any():
                break
        own = q.rows[:, None] == x.rows[None, lo:hi]
        alive &= ~own
        seen[0] += alive.size
        seen[1] += int(alive.sum())
        scores = np.full(alive.shape, -np.inf, dtype=kind)
        if alive.mean() > _DENSE or reach.max() >= 2**53:
            np.copyto(scores, _exact(q.whole, x.whole[lo:hi], reach.max()), where=alive)
        else:
            a, b = np.nonzero(alive)
            for at in range(0, len(a), 1 << 15):
                s = slice(at, at + (1 << 15))
                scores[a[s], b[s]] = np.einsum("ij,ij->i", q.whole[a[s]], x.whole[lo:hi][b[s]])
        both = np.concatenate([best, scores], axis=1)
        best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        least = np.maximum(least, best.min(1))
        a, b = np.nonzero((scores >= least[:, None]) & alive)
        found.append((a, b + lo, scores[a, b].astype(np.int64)))
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    a, b, s = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((x.ids[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    first = np.searchsorted(a, a)
    keep = (np.arange(len(a)) - first < k) & (s >= least[a])
    return a[keep], b[keep], s[keep]


def _rows(q: _Block, qtile: int, query_ids: np.ndarray, x: _Block, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    names = pa.array(x.ids[b], mask=~x.named[b])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), qtile)), pa.array(a.astype(np.int32)), pa.array(q.rows[a]), pa.array(query_ids[a]), pa.array(s), names],
        ["qtile", "pos", "qrow", "query_id", "score", "vec_id"],
    )


def _stored(table: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """Stored ``row, vec_id, n, whole (packed integers), length`` of all whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, sizes, values = finite(batch.column(2))
            whole = scaled(values, scale, _LIMIT)
            ends = np.cumsum(sizes)
            squares = np.concatenate([[0.0], np.cumsum(whole.astype(np.float64) ** 2)])
            packed = [whole[e - n : e].tobytes() for e, n in zip(ends, sizes)]
            kept = pa.array(places)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(kept), batch.column(1).take(kept), pa.array(sizes.astype(np.int32)), pa.array(packed, pa.binary()),
                 pa.array(np.sqrt(np.maximum(squares[ends] - squares[ends - sizes], 0)))],
                ["row", "vec_id", "n", "whole", "length"],
            )

    rows = narrow(table, vec_id=id, vector=vector).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), "vector")
    return pin(rows.mapInArrow(run, "row long, vec_id long, n int, whole binary, length double"), "vectors")


def _rotation(stored: DataFrame, width: int, sample: int) -> np.ndarray:
    """Right singular vectors of a bounded sample, the vectors of smallest hash."""
    rows = stored.orderBy(F.xxhash64("vec_id", "row"), "row").limit(sample).select("n", "whole").collect()
    flat = np.concatenate([np.frombuffer(r["whole"], dtype="<i4") for r in rows]).astype(np.float64)
    x = padded(flat, np.array([r["n"] for r in rows]), width)
    return np.linalg.svd(x, full_matrices=len(x) < width)[2].T


def _tiles(rows: DataFrame, rotation: np.ndarray, rings: int, per_tile: int) -> DataFrame:
    """Stored tiles of ``rows`` by falling length: ``ring, tile`` and its vectors."""
    sent = rows.sparkSession.sparkContext.broadcast(rotation)
    width = len(rotation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tile, ring = [], 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sizes = table["n"].to_numpy().astype(np.int64)
            flat = np.frombuffer(b"".join(table["whole"].to_pylist()), dtype="<i4")
            whole = padded(flat, sizes, width)
            turned = (whole @ sent.value).astype("<f4")
            row, ids = table["row"].to_pylist(), table["vec_id"].to_pylist()
            return pa.RecordBatch.from_arrays(
                [pa.array([ring], pa.int32()), pa.array([tile], pa.int32()), pa.array([table["length"][0].as_py()], pa.float64()), pa.array([row], pa.list_(pa.int64())),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([whole.astype("<i4").tobytes()], pa.binary()), pa.array([turned.tobytes()], pa.binary())],
                ["ring", "tile", "top", "rows", "ids", "whole", "turned"],
            )

        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, per_tile - sum(b.num_rows for b in held))
                held.append(taken)
                batch = batch.slice(taken.num_rows)
                if sum(b.num_rows for b in held) == per_tile:
                    yield flush()
                    held, tile = [], tile + 1
        if held:
            yield flush()

    dealt = rows.repartitionByRange(rings, F.desc("length"), "row").sortWithinPartitions(F.desc("length"), "row")
    return pin(dealt.select("row", "vec_id", "n", "whole", "length").mapInArrow(run, f"ring int, {_TILE}"), "tiles")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qtile", "pos").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _waves(rings: list) -> Iterator[list[tuple[int, int, int, float]]]:
    """(ring, first tile, tiles, length of the longest vector) of each wave; rings are in order of length."""
    most, wave, held = _HEAD, [], 0
    for ring, tiles, top in rings:
        first = 0
        while first < tiles:
            n = min(tiles - first, most - held)
            wave.append((ring, first, n, top))
            first, held = first + n, held + n
            if held == most:
                yield wave
                most, wave, held = most * _GROWTH, [], 0
    if wave:
        yield wave


def search(
    table: DataFrame, queries: Column | None = None, k: int = 20, scale: int = 64, id: str = "vec_id", vector: str = "embedding", sample: int = 4096, counted: dict | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best products of each query row with every other row.

    ``queries`` is a condition on ``vec_id`` (none: every row that has an id). ``counted`` gets how many
    products the waves met and how many of them were computed in full, of all queries times vectors.
    """
    spark = table.sparkSession
    stored = _stored(table, id, vector, scale)
    total, width = stored.agg(F.count("*"), F.max("n")).first()
    width = max(width or 0, 1)
    if total == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rotation = _rotation(stored, width, sample)
    cuts = sorted({max(1, width // 8), max(1, width // 3)})
    per_tile = max(16, _TILE_BYTES // (8 * width))
    rings = int(min(_RINGS, -(-total // per_tile)))
    tiles = _tiles(stored, rotation, rings, per_tile)
    asked = stored.filter("vec_id IS NOT NULL" if queries is None else queries & F.col("vec_id").isNotNull())
    n_asked = asked.count()
    if n_asked == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked_stored = _tiles(asked, rotation, int(min(_RINGS, -(-n_asked // _QUERIES))), min(_QUERIES, per_tile))
    lengths = asked.select(F.col("row").alias("qrow"), "length")
    asked_tiles = asked_stored.select((F.col("ring").cast("long") * (1 << 32) + F.col("tile")).alias("qtile"), "rows", "ids", "whole", "turned")
    met, full = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def block(rows, ids, whole, turned):
        return _Block(rows, ids, whole, turned, width, cuts)

    heads = list(_waves([tuple(r) for r in tiles.groupBy("ring").agg(F.count("*"), F.max("top")).orderBy("ring").collect()]))
    first = None
    for ring, lo, n, _ in heads[0]:
        here = (F.col("ring") == ring) & F.col("tile").between(lo, lo + n - 1)
        first = here if first is None else first | here
    head = spark.sparkContext.broadcast([tuple(r) for r in tiles.filter(first).orderBy("ring", "tile").select("rows", "ids", "whole", "turned").collect()])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tried, seen = [block(*t) for t in head.value], [0, 0]
        for batch in batches:
            for r in batch.to_pylist():
                q = block(r["rows"], r["ids"], r["whole"], r["turned"])
                least = np.full(len(q.rows), -np.inf)
                for x in tried:
                    a, b, s = _pair(q, x, least, k, cuts, seen)
                    yield _rows(q, r["qtile"], q.ids, x, a, b, s)
        met.add(seen[0])
        full.add(seen[1])

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last, x = [0, 0], None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["ring"], r["tile"]) != last:
                    last, x = (r["ring"], r["tile"]), block(r["xrows"], r["xids"], r["xwhole"], r["xturned"])
                q = block(r["rows"], r["ids"], r["whole"], r["turned"])
                least = np.array([-np.inf if v is None else v for v in r["least"]])
                a, b, s = _pair(q, x, least, k, cuts, seen)
                yield _rows(q, r["qtile"], q.ids, x, a, b, s)
        met.add(seen[0])
        full.add(seen[1])

    best = pin(_best(asked_tiles.mapInArrow(start, _FOUND), k), "best")
    for wave in heads[1:]:
        known = best.groupBy("qtile", "qrow", "pos").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        per_query = known.join(lengths, "qrow").select("qtile", "pos", F.when(F.col("n") == k, F.col("worst")).alias("least"), "length")
        bounds = per_query.groupBy("qtile").agg(
            F.map_from_entries(F.collect_list(F.struct("pos", "least"))).alias("by_pos"),
            # the shortest vector that can still matter to any query of the tile; null: all can
            F.when(F.count_if(F.coalesce("least", F.lit(0)) <= 0) == 0, F.min(F.col("least") / F.col("length"))).alias("needs"),
        )
        held = asked_tiles.join(bounds, "qtile", "left").withColumn(
            "least", F.transform(F.sequence(F.lit(0), F.size("rows") - 1), lambda p: F.try_element_at("by_pos", p))
        ).withColumn("needs", F.when(F.size("by_pos") == F.size("rows"), F.col("needs"))).drop("by_pos")
        offers = F.arrays_zip(*[F.lit(list(c)).alias(n) for n, c in zip(("ring", "first", "n", "top"), zip(*wave))])
        met_rings = F.filter(offers, lambda o: F.col("needs").isNull() | (o["top"] * (1 + 1e-9) >= F.col("needs")))
        visits = held.withColumn("o", F.explode(met_rings)).withColumn("ring", F.col("o.ring").cast("int")).withColumn(
            "tile", F.explode(F.sequence(F.col("o.first").cast("int"), (F.col("o.first") + F.col("o.n") - 1).cast("int")))
        ).drop("o", "needs")
        there = tiles.select("ring", "tile", F.col("rows").alias("xrows"), F.col("ids").alias("xids"), F.col("whole").alias("xwhole"), F.col("turned").alias("xturned"))
        more = visits.join(there, ["ring", "tile"]).mapInArrow(go_on, _FOUND)
        before, best = best, pin(_best(best.drop("rank").unionByName(more), k), "best")
        unpin(before)
    head.unpersist()
    unpin(stored, tiles, asked_stored)
    if counted is not None:
        counted.update(met=met.value, full=full.value, all=n_asked * total, waves=len(heads))
    return best.select("query_id", "rank", "vec_id", "score")
