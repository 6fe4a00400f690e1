"""Strict forward as-of join on an integer time, within a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def asof_forward(
    left: DataFrame,
    right: DataFrame,
    by: str,
    on: str,
    values: Sequence[str],
    tolerance: int,
    order: str = "row_id",
    match: str = "match",
) -> DataFrame:
    """Attach to each left row the nearest later right row of the same key.

    `0 < right.on - left.on <= tolerance`; among equal times the right row with
    the smallest `order` wins. Unmatched left rows keep a null `match`, a
    struct of (`on`, `order`, *values).

    The right side shrinks to one row per (key, time) before anything is
    gathered. Its rows go to the time bucket they lie in and the one before,
    so a bucket's sorted list holds at most twice `tolerance` entries even for
    a key with a third of all rows, and every left row needs a single equi join
    on (key, bucket), whose left side Spark may split when it is skewed.
    """
    if tolerance < 1:
        return left.withColumn(match, F.lit(None).cast(f"struct<{on}:bigint,{order}:bigint>"))
    width = F.lit(int(tolerance))
    nearest = (
        right.groupBy(by, on)
        .agg(F.min(F.struct(F.col(order), *[F.col(v) for v in values])).alias("_first"))
        .select(by, F.struct(F.col(on), F.col(f"_first.{order}").alias(order), *[F.col(f"_first.{v}").alias(v) for v in values]).alias("_m"))
    )
    bucket = F.floor(F.col(f"_m.{on}") / width)
    lists = (
        nearest.withColumn("_bkt", F.explode(F.array(bucket, bucket - 1)))
        .groupBy(by, "_bkt")
        .agg(F.sort_array(F.collect_list("_m")).alias("_later"))
    )
    joined = left.withColumn("_bkt", F.floor(F.col(on) / width)).join(lists, [by, "_bkt"], "left")
    within = F.filter("_later", lambda m: (m[on] > F.col(on)) & (m[on] <= F.col(on) + width))
    return joined.withColumn(match, F.try_element_at(within, F.lit(1))).drop("_bkt", "_later")
