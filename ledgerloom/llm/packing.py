"""Best-fit packing of token pieces by hierarchical residual rounds.

Round 0 packs slices of the pieces where they lie, best fit by decreasing size,
without a shuffle. Bins that are nearly full are final. The underfull ones are
the items of the next round: they meet in fewer groups, a group being the union
of some groups before, and are packed again by best fit, whole bins into bins.
A group never holds more than about ``group_items`` items: when the residue is
larger, groups stop merging and are dealt anew instead, and rounds end when one
group is left or a round saves less than one bin in a thousand.

Only (bin, fill) pairs travel between rounds. Every round stores (bin, parent,
shift); the last step follows these small tables from the top down.

Cases: a null text is empty and is its end id alone. Null ids and repeated rows
are packed like any others, each row on its own. A document above the capacity
is cut into pieces of exactly the capacity and a rest. Ties go to the piece met
first. An empty table gives no pieces. Only id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import narrow
from ledgerloom.llm.tokens import as_u32, encoder
from ledgerloom.session import new_path, pin

CAPACITY = 4096
_SLACK = 16  # a bin with no more free tokens is nearly full
#: A bin's name holds its round in five bits. Groups merge by eight, so a billion of them take ten rounds; further
#: ones deal a residue of more than ``group_items`` bins anew, as long as that saves one bin in a thousand.
_ROUNDS = 31
_PIECES = "piece int, start long, length long, ids_crc32 long, ids binary"
_BYTES = 1 << 22  # bytes of ids that a task gives back at a time


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored pieces: ``pid, doc_id, piece, start, length, ids_crc32, ids`` (packed little-endian ids)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary)
        end, width = np.array([end_id], dtype=model.dtype).tobytes(), model.dtype.itemsize * capacity

        def flush(names: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            at, number, lengths, sums, ids = zip(*rows)
            number = np.array(number)
            columns = [names.take(pa.array(at)), pa.array(number, pa.int32()), pa.array(number * capacity, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()), pa.array(ids, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", *[f.split()[0] for f in _PIECES.split(", ")]])

        for batch in batches:
            rows, size = [], 0
            for i, packed in enumerate(model.encode_many(t.as_py() for t in batch.column(1))):
                packed += end
                size += len(packed)
                for k, a in enumerate(range(0, len(packed), width)):
                    ids = packed[a : a + width]
                    rows.append((i, k, len(ids) // model.dtype.itemsize, zlib.crc32(as_u32(ids, model.dtype).tobytes()), ids))
                if size > _BYTES:
                    yield flush(batch.column(0), rows)
                    rows, size = [], 0
            if rows:
                yield flush(batch.column(0), rows)

    spark = docs.sparkSession
    rows = narrow(docs, doc_id=id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(cut, f"doc_id {kind}, {_PIECES}").select(F.monotonically_increasing_id().alias("pid"), "*")
    path = new_path(spark, "pieces")
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit by decreasing size: the bin number and the place inside it of each item.

    The set of free sizes that occur is one big integer, so the tightest bin that
    fits is its lowest set bit at or above the item's size.
    """
    bins = np.empty(len(sizes), dtype=np.int64)
    places = np.empty(len(sizes), dtype=np.int64)
    by_free: dict[int, list[int]] = {}
    occurring, count = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = occurring >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            stack = by_free[free]
            b = stack.pop()
            if not stack:
                occurring ^= 1 << free
        else:
            b, free, count = count, capacity, count + 1
        bins[i], places[i] = b, capacity - free
        free -= size
        if free:
            stack = by_free.setdefault(free, [])
            if not stack:
                occurring |= 1 << free
            stack.append(b)
    return bins, places


def _first_round(items: DataFrame, capacity: int, slice_items: int) -> DataFrame:
    """Packs slices of each partition; adds ``bin, place, fill``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, base = 0, TaskContext.get().partitionId() << 36

        def flush() -> pa.RecordBatch:
            nonlocal held, count, base
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sizes = rows.column(rows.schema.get_field_index("length")).to_numpy()
            bins, places = best_fit(sizes, capacity)
            fill = np.bincount(bins, weights=sizes).astype(np.int64)
            out = pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(bins + base), pa.array(places), pa.array(fill[bins])], [*rows.schema.names, "bin", "place", "fill"]
            )
            held, count, base = [], 0, base + len(fill)
            return out

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= slice_items:
                yield flush()
        if count:
            yield flush()

    schema = T.StructType([*items.schema.fields, *[T.StructField(n, T.LongType()) for n in ("bin", "place", "fill")]])
    return items.mapInArrow(run, schema)


def _next_round(residue: DataFrame, capacity: int, number: int) -> DataFrame:
    """Packs the bins of each group (a bounded number); ``bin, parent, shift, fill`` with the parent's fill."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin", kind="stable")
        bins, places = best_fit(rows["fill"].to_numpy(), capacity)
        fill = np.bincount(bins, weights=rows["fill"]).astype(np.int64)
        names = (np.int64(number) << np.int64(58)) + (np.int64(key[0]) << np.int64(32))
        return pd.DataFrame({"bin": rows["bin"], "parent": bins + names, "shift": places, "fill": fill[bins], "home": key[0]})

    return residue.groupBy("home").applyInPandas(run, "bin long, parent long, shift long, fill long, home long")


def assign(pieces: DataFrame, capacity: int = CAPACITY, slack: int = _SLACK, slice_items: int = 50_000, group_items: int = 200_000, arity: int = 8) -> DataFrame:
    """``sequence_id`` and ``offset`` for every piece, beside all its other columns but ``ids``."""
    items = pieces.drop("ids")
    slices = max(1, -(-items.count() // slice_items))  # small partitions are packed together
    packed = pin(_first_round(items.coalesce(slices), capacity, slice_items), "packed")
    open_bins = packed.filter((F.col("place") == 0) & (F.col("fill") < capacity - slack))
    residue = pin(open_bins.select("bin", "fill", F.shiftright("bin", 36).alias("home")), "residue")
    count, groups = residue.agg(F.count("*"), F.countDistinct("home")).first()
    levels, number = [], 0
    while count > 1 and number < _ROUNDS:
        number, before = number + 1, groups
        fewer = max(-(-count // group_items), -(-groups // arity))
        home = F.pmod("home", F.lit(fewer)) if fewer < groups else F.pmod(F.xxhash64("bin", F.lit(number)), F.lit(fewer))
        dealt = residue.select("bin", "fill", home.cast("long").alias("home"))
        level = pin(_next_round(dealt, capacity, number), "level")
        levels.append(level)
        heads = level.filter("shift = 0").select(F.col("parent").alias("bin"), "fill", "home")
        residue = heads.filter(F.col("fill") < capacity - slack)
        bins, left = heads.agg(F.count("*"), F.sum((F.col("fill") < capacity - slack).cast("long"))).first()
        saved, last = count - bins, fewer == 1
        count, groups = left or 0, fewer
        if last or (saved * 1000 < bins and fewer >= before):
            break
    final = None
    for level in reversed(levels):
        step = level.select("bin", "parent", "shift")
        if final is not None:
            up = final.select(F.col("bin").alias("parent"), F.col("sequence_id").alias("top"), F.col("moved").alias("up"))
            step = step.join(up, "parent", "left").select(
                "bin", F.coalesce("top", "parent").alias("parent"), (F.col("shift") + F.coalesce("up", F.lit(0))).alias("shift")
            )
        final = step.select("bin", F.col("parent").alias("sequence_id"), F.col("shift").alias("moved"))
    if final is None:
        return packed.withColumn("sequence_id", F.col("bin")).withColumn("offset", F.col("place")).drop("bin", "place", "fill")
    out = packed.join(final, "bin", "left")
    return out.select(
        *items.columns, F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("moved", F.lit(0))).alias("offset")
    )


def laid_out(pieces: DataFrame, assigned: DataFrame) -> DataFrame:
    """The packed sequences, piece by piece: ``assigned`` with ``ids``, each sequence's pieces in one partition, in order."""
    held = assigned.join(pieces.select("pid", "ids"), "pid")
    return held.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")


def sequences(pieces: DataFrame, assigned: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, length, ids`` (ids of all its pieces, packed, in order)."""
    rows = pieces.select("pid", "length", "ids").join(assigned.select("pid", "sequence_id", "offset"), "pid")
    whole = rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
