"""Ordered work that stays parallel however the keys are spread.

Two situations would otherwise put an unbounded sort into one task:

* an ordered window without a key (global row index, running totals over all
  scores): `global_index` and `running_totals` range-split the rows, pin the
  split, and add each split's offset;
* an ordered window on a key that holds a large share of all rows: `HotKeys`
  cuts only such keys into blocks of consecutive rows, and `prior_totals` /
  `prior_rows` carry what earlier blocks contribute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import pin

HOT_ROWS = 2_000_000
BLOCK_ROWS = 2_000_000


def _ordered_splits(df: DataFrame, order: Sequence[str | Column], label: str, keep: Sequence[str] | None = None) -> DataFrame:
    """Range-split on `order`, pinned; `_split` grows with the order, `_pos` counts inside it.

    Only the columns in `keep` are stored, if it is given.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    stored = pin(placed.select(*keep, "_mid") if keep else placed, label)
    out = (
        stored.withColumn("_split", F.shiftright("_mid", 33))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid")
    )
    out._pinned = stored._pinned
    return out


def _split_offsets(totals: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sum of each column over earlier splits: one row per range split, at most
    `spark.sql.shuffle.partitions` rows, so one task and a broadcast suffice."""
    earlier = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_split",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names],
    )


def global_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_id", keep: Sequence[str] | None = None) -> DataFrame:
    """Dense 0-based index in the given total order, without a single-task sort.

    With `keep`, only these columns are stored and returned beside the index. `unpin` deletes what was stored.
    """
    placed = _ordered_splits(df, order, "indexed", keep)
    totals = placed.groupBy("_split").agg(F.count("*").alias("n"))
    out = (
        placed.join(F.broadcast(_split_offsets(totals, ["n"])), "_split")
        .withColumn(name, (F.col("_before_n") + F.col("_pos")).cast("long"))
        .drop("_split", "_pos", "_before_n")
    )
    out._pinned = placed._pinned
    return out


def running_totals(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums over the whole frame in the given total order.

    `sums` maps an output column to the column it accumulates.
    """
    placed = _ordered_splits(df, order, "running")
    names = list(sums.values())
    totals = placed.groupBy("_split").agg(*[F.sum(n).alias(n) for n in names])
    inside = Window.partitionBy("_split").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(_split_offsets(totals, names)), "_split")
    for target, source in sums.items():
        out = out.withColumn(target, F.col(f"_before_{source}") + F.sum(source).over(inside))
    return out.drop("_split", "_pos", *[f"_before_{n}" for n in names])


class HotKeys:
    """Keys of `df` that hold more than `hot_rows` rows, and their blocks.

    A block is `index // block_rows`; `index` is dense over the frame, so no
    block holds more than `block_rows` rows. The keys are looked up first: a
    frame of at most `hot_rows` rows cannot have any, otherwise they are counted
    and stored. At most rows / `hot_rows` keys can be hot, which bounds the
    broadcast. `found` tells whether there are any; without them callers leave
    the carrying branches out of their plan altogether.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        index: str = "row_id",
        hot_rows: int = HOT_ROWS,
        block_rows: int = BLOCK_ROWS,
        rows: int | None = None,
    ) -> None:
        """`rows` is the frame's row count, if the caller has it already."""
        self.keys, self.index, self.block_rows = list(keys), index, block_rows
        self.found = False
        if (df.count() if rows is None else rows) > hot_rows:
            counts = df.groupBy(*self.keys).agg(F.count("*").alias("_n"))
            hot = pin(counts.where(F.col("_n") > hot_rows).select(*self.keys, F.lit(True).alias("_hot")), "hot")
            self.found = not hot.isEmpty()
            self.hot = F.broadcast(hot)

    def _block(self) -> Column:
        return F.floor(F.col(self.index) / F.lit(self.block_rows)).cast("long")

    def blocks(self, df: DataFrame) -> DataFrame:
        """All rows with `_blk`: -1 for ordinary keys."""
        if not self.found:
            return df.withColumn("_blk", F.lit(-1).cast("long"))
        return (
            df.join(self.hot, self.keys, "left")
            .withColumn("_blk", F.when(F.col("_hot"), self._block()).otherwise(F.lit(-1).cast("long")))
            .drop("_hot")
        )

    def only(self, df: DataFrame) -> DataFrame | None:
        """Rows of hot keys, with `_blk`; None when there are none."""
        if not self.found:
            return None
        return df.join(self.hot, self.keys).withColumn("_blk", self._block()).drop("_hot")

    def carry(self, df: DataFrame, carried: DataFrame | None, columns: dict[str, str]) -> DataFrame:
        """Join what earlier blocks pass on; `columns` gives its names and types."""
        if carried is None:
            return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items()})
        return df.join(carried, [*self.keys, "_blk"], "left")


def prior_totals(hot: DataFrame | None, keys: Sequence[str], aggs: dict[str, tuple[str, Column]]) -> DataFrame | None:
    """What earlier blocks of the same hot key add up to, per (key, block).

    `aggs` maps an output column to ("sum" | "min" | "max", expression).
    """
    if hot is None:
        return None
    keys = list(keys)
    combine = {"sum": F.sum, "min": F.min, "max": F.max}
    per_block = hot.groupBy(*keys, "_blk").agg(*[combine[how](expr).alias(name) for name, (how, expr) in aggs.items()])
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(
        *keys, "_blk", *[combine[how](F.col(name)).over(earlier).alias(name) for name, (how, _) in aggs.items()]
    )


def prior_rows(
    hot: DataFrame | None, keys: Sequence[str], order: Sequence[str], values: Sequence[str], n: int, name: str
) -> DataFrame | None:
    """The last `n` rows of earlier blocks of a hot key, oldest first, per (key, block)."""
    if hot is None:
        return None
    keys = list(keys)
    newest_first = Window.partitionBy(*keys, "_blk").orderBy(*[F.desc(c) for c in order])
    tails = (
        hot.withColumn("_rn", F.row_number().over(newest_first))
        .where(F.col("_rn") <= n)
        .groupBy(*keys, "_blk")
        .agg(F.sort_array(F.collect_list(F.struct(*order, *values))).alias("_tail"))
    )
    # n earlier blocks are enough: every block that exists holds at least one row
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(-n, -1)
    joined = tails.withColumn("_all", F.flatten(F.collect_list("_tail").over(earlier)))
    first = F.greatest(F.size("_all") - F.lit(n), F.lit(0)) + 1
    return joined.select(*keys, "_blk", F.slice("_all", first, F.lit(n)).alias(name))


def lookback_buckets(df: DataFrame, time: str, width: int, bucket: str = "_bkt", halo: str = "_halo") -> DataFrame:
    """Emit each row into its time bucket and, as halo, into the next one.

    A window over (key, bucket) then sees everything up to `width` back, so a
    bounded look-back never needs the whole key in one task.
    """
    own = F.floor(F.col(time) / F.lit(width))
    return (
        df.withColumn("_b", F.explode(F.array(F.struct(own.alias("b"), F.lit(False).alias("h")), F.struct((own + 1).alias("b"), F.lit(True).alias("h")))))
        .withColumn(bucket, F.col("_b.b"))
        .withColumn(halo, F.col("_b.h"))
        .drop("_b")
    )
