"""Connected components of a link table, by alternating star contraction.

The link table shrinks towards one link per node; each round is written to the
shared folder, so lineage stays short and lost executors cost one round at most.
Minima are aggregated before any join, so a hub costs one row in each task, and
joins on a hub's key are plain equi-joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import pin


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (a, b) with a > b."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    kept = low.select("a", F.col("m").alias("b"))
    moved = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(moved).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link to a smaller one; root is the smallest node reachable.

    ``links`` has long columns a and b in any order; loops and repeats are fine.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    state, before = pin(ordered, "links"), None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, before = pin(_stars(state), "links"), now
