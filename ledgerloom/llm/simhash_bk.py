"""SimHash near-duplicates: sharded BK-trees over distinct fingerprints.

Texts become 64-bit fingerprints; equal ones collapse to one node, so copies cost
nothing further. Two fingerprints at 3 or fewer differing bits agree on at least
one of four 16-bit blocks, so each node goes to its four shards and only there a
BK-tree (children keyed by Hamming distance to the parent) is grown and searched
along edges within the radius. A shard with more nodes than ``shard_nodes`` is
split again, losslessly, by four 12-bit blocks of its other 48 bits; what is still
larger (many fingerprints alike in 28 bits) is cut into trees of bounded size,
and each tree is sent to all slices of its shard's nodes. A shard reports one link per node to its
local component, never all pairs, and links are contracted to components.

Trees travel with their queries by a shuffle instead of through the driver,
because all fingerprints together grow with the corpus.

Cases: null and empty texts have no words, fingerprint zero, and are linked with
each other like any others. A null id is never a component's id unless all of its
component's ids are null. Repeated rows are copies. Texts of any length are read
whole. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import _LOWER_BYTES, narrow
from ledgerloom.llm.components import components
from ledgerloom.session import pin

SEED, RADIUS, WIDTH = 42, 3, 3
_CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash over ``width``-word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    n = max(1, len(words) - width + 1)
    ends = ends[min(width, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())
        ones += _ones(np.array([digest(line[a:b], SEED) for a, b in spans], dtype="<u8"))
    return _over_half(ones, n)


def set_fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of shingles given by their hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += _ones(hashes[at : at + _CHUNK].astype("<u8"))
    return _over_half(ones, len(hashes))


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _over_half(ones: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


class BKTree:
    """Integers under Hamming distance; a child hangs on the edge of its distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new, at = len(self.values), 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return
            nxt = self.children[at].setdefault(d, new)
            if nxt == new:
                break
            at = nxt
        self.values.append(value)
        self.children.append({})

    def near(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(self.values[at])
            if kids := self.children[at]:
                todo += [kid for edge, kid in kids.items() if d - radius <= edge <= d + radius]
        return found


def local_links(nodes, queries, radius: int) -> list[tuple[int, int]]:
    """One link (value, smallest of its local component) per linked value."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    tree = BKTree()
    own = queries is None
    if not own:
        for x in nodes:
            tree.add(x)
    for q in nodes if own else queries:
        for near in tree.near(q, radius):
            a, b = root(near), root(q)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if own:
            tree.add(q)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def _sharded(radius: int):
    """Batches of (shard, side, fp), sorted, to links; a shard may span batches and is bounded."""

    def flush(fps: list[int], sides: list[int], out: list) -> None:
        if len(fps) > 1:
            tree = [f for f, s in zip(fps, sides) if s == 0]
            slices = [f for f, s in zip(fps, sides) if s == 1]
            out += local_links(tree, slices or None, radius)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fps, sides = None, [], []
        for batch in batches:
            shard, fp, side = batch["shard"].to_numpy(), batch["fp"].to_numpy().view(np.uint64), batch["side"].to_numpy()
            cuts = np.flatnonzero(np.diff(shard)) + 1
            edges = [0, *cuts.tolist(), len(shard)]
            out: list[tuple[int, int]] = []
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if shard[a] != key:
                    flush(fps, sides, out)
                    key, fps, sides = shard[a], [], []
                    if b - a == 1 and b < len(shard):  # alone, and complete
                        continue
                fps += fp[a:b].tolist()
                sides += side[a:b].tolist()
            if out:
                yield _frame(out)
        out = []
        flush(fps, sides, out)
        if out:
            yield _frame(out)

    return run


def _frame(links: list[tuple[int, int]]) -> pd.DataFrame:
    pairs = np.array(links, dtype=np.uint64).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _block(fp: Column, bits: int, i: int) -> Column:
    return F.shiftrightunsigned(fp, bits * i).bitwiseAND(F.lit((1 << bits) - 1))


def _others(fp: Column, i: int) -> Column:
    """The 48 bits outside 16-bit block ``i``."""
    low = fp.bitwiseAND(F.lit((1 << 16 * i) - 1))
    return low if i == 3 else F.shiftleft(F.shiftrightunsigned(fp, 16 * (i + 1)), 16 * i).bitwiseOR(low)


def _crowded(rows: DataFrame, most: int) -> DataFrame:
    """Shards with more than ``most`` nodes; at most rows / most of them."""
    return pin(rows.groupBy("shard").count().filter(F.col("count") > most), "crowded")


def shard_links(nodes: DataFrame, radius: int = RADIUS, shard_nodes: int = 2000) -> DataFrame:
    """Links (a, b) between fingerprints ``fp``, enough to connect all pairs within the radius (3 at most)."""
    if not 0 <= radius <= 3:
        raise ValueError("four blocks find pairs up to radius 3")
    fp = F.col("fp")
    first = F.array(*[F.struct(F.lit(i).alias("i"), (_block(fp, 16, i) + F.lit(i << 16)).alias("shard")) for i in range(4)])
    keys = nodes.select("fp", F.explode(first).alias("k")).select("fp", "k.i", "k.shard")
    crowded = _crowded(keys, shard_nodes)
    parts = [keys.join(crowded, "shard", "left_anti").select("shard", F.lit(0).alias("side"), "fp")]
    if not crowded.isEmpty():
        rest = F.element_at(F.array(*[_others(fp, i) for i in range(4)]), F.col("i") + 1)
        hot = keys.join(crowded.select("shard"), "shard", "left_semi").select("fp", "shard", rest.alias("rest"))
        second = F.array(*[F.shiftleft(F.col("shard"), 14) + F.lit(j << 12) + _block(F.col("rest"), 12, j) + F.lit(1 << 40) for j in range(4)])
        split = hot.select("fp", F.explode(second).alias("shard"))
        dense = _crowded(split, shard_nodes)
        parts.append(split.join(dense, "shard", "left_anti").select("shard", F.lit(0).alias("side"), "fp"))
        if not dense.isEmpty():
            cut = split.join(dense, "shard").withColumn("n", F.ceil(F.col("count") / (shard_nodes // 2)))
            cut = cut.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")))
            tile = lambda a, b: F.xxhash64("shard", a, b).bitwiseOR(F.lit(-(1 << 63)))
            as_tree = F.transform(F.sequence(F.col("c"), F.col("n") - 1), lambda o: F.struct(tile(F.col("c"), o).alias("shard"), F.lit(0).alias("side")))
            as_query = F.transform(
                F.filter(F.sequence(F.lit(0).cast("long"), F.col("c")), lambda o: o < F.col("c")),
                lambda o: F.struct(tile(o, F.col("c")).alias("shard"), F.lit(1).alias("side")),
            )
            parts.append(cut.select("fp", F.explode(F.concat(as_tree, as_query)).alias("t")).select("t.shard", "t.side", "fp"))
    links = None
    for part in parts:
        tasks = part.repartition("shard").sortWithinPartitions("shard", "side", "fp")
        found = tasks.mapInPandas(_sharded(radius), "a long, b long")
        links = found if links is None else links.union(found)
    return links


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, shard_nodes: int = 2000) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id, copies``.

    ``component_id`` is the smallest id reachable over links; ``copies`` counts the
    documents with the very same fingerprint.
    """
    rows = narrow(docs, doc_id=id, text=text)
    prints = pin(rows.select("doc_id", simhash("text").alias("fp")), "prints")
    nodes = pin(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "nodes")
    roots = components(shard_links(nodes, radius, shard_nodes))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    labelled = pin(labelled, "labelled")
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("members")).filter("members > 1")
    shared = pin(labelled.join(smallest, "root").select("fp", "component_id", "copies"), "shared")
    out = prints.join(shared, "fp", "left")
    return out.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component stays, that with the smallest id; of rows that repeat an id, one stays.

    Rows with a null id cannot be told apart by id and all stay.
    """
    classes = pin(near_duplicates(docs, id, text), "classes")
    goes = classes.filter("doc_id <> component_id").select(F.col("doc_id").alias("_goes"))
    kept = docs.join(goes, docs[id] == F.col("_goes"), "left_anti")
    again = classes.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("_again")).count().filter("count > 1").drop("count")
    again = pin(again, "again")
    if again.isEmpty():
        return kept
    twice = kept.join(again, kept[id] == F.col("_again"), "left_semi").dropDuplicates([id])
    return kept.join(again, kept[id] == F.col("_again"), "left_anti").unionByName(twice)
