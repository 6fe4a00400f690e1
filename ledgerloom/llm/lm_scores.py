"""Language-model scores of whole texts: Spark jobs around ``context_mix``.

One pass over the training texts counts words (by 64-bit hash) and, per hashed
context, following bytes. Tasks report only cells that occur; counts of words
are added by a grouped sum, those of contexts block by block, each block of
contexts in one place at a time. The tables of log-odds have a fixed size, set by
the kinds of context; the counts behind them come from every training byte.

A second pass scores every text. Workers read the stored tables from the shared
folder, never through the driver. Word counts are held by workers only if there
are at most ``held_words`` of them; beyond that they are joined, with the same result.

Cases: a null text is empty: its score is that of the end alone. A null id counts
as an empty one for the split. Repeated rows are scored, and learned, as often as
they occur. An empty table gives no rows. If nothing is in training, all counts are 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import context_mix as mix
from ledgerloom.llm.common import _LOWER_BYTES, narrow
from ledgerloom.session import new_path, pin

#: Contexts per block of the table.
ROWS = 256
_END = b" "  # no word has a space
_BATCH = 1 << 20


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 5 == 1


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text, and its end."""
    out = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).split()
    out.append(_END)
    return out


def _hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts (block -1: hash and count) and context counts (block: packed cells and counts)."""
    _scorer.cache_clear()  # a worker that scored before need not hold two models
    _word_counts.cache_clear()
    table = np.zeros((mix.CONTEXTS, 256), dtype=np.uint32)
    seen: Counter[bytes] = Counter()
    texts: list[bytes] = []
    size = rows = 0

    def word_rows() -> pa.RecordBatch:
        hashes = pa.array([_hash(w) for w in seen], pa.int64())
        n = len(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, -1, dtype=np.int32)), hashes, pa.array(list(seen.values()), pa.int64()), pa.nulls(n, pa.binary())],
            ["block", "word", "n", "cells"],
        )

    for batch in batches:
        for t in batch.column(0):
            text = t.as_py()
            found = words(text)
            seen.update(found)
            data = (text or "").encode("utf-8", "surrogatepass") + b"\0"
            texts.append(data)
            size, rows = size + len(data), rows + 1
            if size >= _BATCH:
                mix.count(texts, table)
                texts, size = [], 0
            if len(seen) > 200_000:
                yield word_rows()
                seen.clear()
    mix.count(texts, table)
    if seen:
        yield word_rows()
    if rows:
        blocks, packed = [], []
        for b in range(mix.CONTEXTS // ROWS):
            part = table[b * ROWS : (b + 1) * ROWS].reshape(-1)
            cells = np.flatnonzero(part)
            if len(cells):
                blocks.append(b)
                packed.append(zlib.compress(cells.astype("<u2").tobytes() + part[cells].astype("<u4").tobytes(), 1))
        n = len(blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(packed, pa.binary())],
            ["block", "word", "n", "cells"],
        )


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums the cells of each block; rows come ordered by block, so one block is open at a time."""
    block, total = None, None

    def done() -> pd.DataFrame:
        odds = mix.log_odds(total.reshape(ROWS, 256))
        return pd.DataFrame({"block": [block], "odds": [zlib.compress(odds.tobytes(), 1)]})

    for frame in batches:
        for b, cells in zip(frame["block"], frame["cells"]):
            if b != block:
                if block is not None:
                    yield done()
                block, total = b, np.zeros(ROWS * 256, dtype=np.int64)
            data = zlib.decompress(cells)
            n = len(data) // 6
            total[np.frombuffer(data, "<u2", n)] += np.frombuffer(data, "<u4", n, 2 * n)
    if block is not None:
        yield done()


class Model:
    """Where the stored tables are, and the three totals of the word model."""

    def __init__(self, odds: str, words: str, tokens: int, distinct: int):
        self.odds, self.words, self.tokens, self.distinct = odds, words, tokens, distinct


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts all given texts and stores the tables in the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(docs[text].alias("text"))
    counted = pin(rows.mapInArrow(_gather, "block int, word bigint, n bigint, cells binary"), "lm-counts")
    paths = [new_path(spark, "lm-odds"), new_path(spark, "lm-words")]
    blocks = counted.filter("block >= 0").select("block", "cells").repartition("block").sortWithinPartitions("block")
    blocks.mapInPandas(_merge, "block int, odds binary").write.parquet(paths[0])
    counted.filter("block = -1").groupBy("word").agg(F.sum("n").alias("n")).write.parquet(paths[1])
    tokens, distinct = spark.read.schema("word bigint, n bigint").parquet(paths[1]).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return Model(*paths, int(tokens), int(distinct))


def _stored(uri: str) -> pa.Table:
    store, path = fs.FileSystem.from_uri(uri)
    names = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
    return ds.dataset(names, filesystem=store, format="parquet").to_table() if names else pa.table({})


@lru_cache(maxsize=1)
def _scorer(uri: str) -> mix.Scorer:
    table = np.zeros((mix.CONTEXTS, 256, 8), dtype=np.int8)
    stored = _stored(uri)
    for b, odds in zip(stored["block"].to_pylist(), stored["odds"]) if stored.num_rows else ():
        table[b * ROWS : (b + 1) * ROWS] = np.frombuffer(zlib.decompress(odds.as_py()), np.int8).reshape(ROWS, 256, 8)
    return mix.Scorer(table)


@lru_cache(maxsize=1)
def _word_counts(uri: str) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    stored = _stored(uri)
    if not stored.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), {}
    hashes, counts = stored["word"].to_numpy(), stored["n"].to_numpy()
    del stored
    order = np.argsort(hashes)
    return hashes[order], counts[order], {}


def _log_share(count, model_tokens: int, distinct: int):
    return np.log10((count + 0.5) / (model_tokens + 0.5 * (distinct + 1)))


def _known(found: Counter[bytes], uri: str) -> np.ndarray:
    """Training counts of the given words."""
    hashes, counts, cache = _word_counts(uri)
    missing = [w for w in found if w not in cache]
    if missing:
        if len(cache) > 150_000:
            cache.clear()
            missing = list(found)
        keys = np.array([_hash(w) for w in missing], dtype=np.int64)
        at = np.minimum(np.searchsorted(hashes, keys), max(0, len(hashes) - 1))
        got = np.where(hashes[at] == keys, counts[at], 0) if len(hashes) else np.zeros(len(keys), np.int64)
        cache.update(zip(missing, got.tolist()))
    return np.array([cache[w] for w in found], dtype=np.int64)


_BASE = "n_tokens bigint, n_known bigint, base_score double"
_BITS = "score double, bits double, n_bytes bigint"


def _score(model: Model, held: bool):
    """Texts to their scores; without held word counts, to their (word, times) lists instead of the base score."""

    def base(found: list[bytes]) -> tuple:
        times = Counter(found)
        if not held:
            return ([{"word": _hash(w), "times": k} for w, k in times.items()],)
        counts, k = _known(times, model.words), np.fromiter(times.values(), dtype=np.int64)
        return len(found), int(k[counts > 0].sum()), float((k * _log_share(counts, model.tokens, model.distinct)).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model.odds)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            a = 0
            while a < batch.num_rows:
                data, own, size, b = [], [], 0, a
                while b < batch.num_rows and (b == a or size < _BATCH):
                    text = texts[b].as_py()
                    data.append((text or "").encode("utf-8", "surrogatepass") + b"\0")
                    own.append(base(words(text)))
                    size, b = size + len(data[-1]), b + 1
                bits = scorer.bits(data)
                part = batch.slice(a, b - a)
                columns = [pa.array(c) for c in zip(*own)] if held else [
                    pa.array([len_words(o[0]) for o in own], pa.int64()),
                    pa.array([o[0] for o in own], pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int64())]))),
                ]
                columns += [pa.array(-bits * np.log10(2)), pa.array(bits), pa.array([len(d) - 1 for d in data], pa.int64())]
                names = (["n_tokens", "n_known", "base_score"] if held else ["n_tokens", "found"]) + ["score", "bits", "n_bytes"]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*part.schema.names[:-1], *names])
                a = b

    return run


def len_words(found: list[dict]) -> int:
    return sum(f["times"] for f in found)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", held_words: int = 8_000_000) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score, bits, n_bytes`` of every text; scores are log10 probabilities."""
    rows = narrow(docs, doc_id=id, text=text)
    kind = dict(rows.dtypes)["doc_id"]
    if model.distinct <= held_words:
        return rows.mapInArrow(_score(model, True), f"doc_id {kind}, {_BASE}, {_BITS}")
    found = "n_tokens bigint, found array<struct<word:bigint,times:bigint>>"
    scored = rows.mapInArrow(_score(model, False), f"doc_id {kind}, {found}, {_BITS}")
    scored = pin(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    counts = docs.sparkSession.read.schema("word bigint, n bigint").parquet(model.words)
    each = scored.select("row", F.explode("found").alias("f")).select("row", "f.word", "f.times")
    met = each.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.log10((F.col("n") + 0.5) / F.lit(model.tokens + 0.5 * (model.distinct + 1)))
    base = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_known"), F.sum(F.col("times") * share).alias("base_score")
    )
    return scored.join(base, "row").select("doc_id", "n_tokens", "n_known", "base_score", "score", "bits", "n_bytes")
