"""Benchmark decontamination by edit distance.

Texts and items are lower-cased words (``\\w+``). A document holds an item of n
words if some stretch of it is within floor((1 - similarity) * n) word edits.

1. Count filter, lossless: k edits break at most 2k of the item's n - 1 word
   pairs, so only stretches with enough pairs that occur in the benchmark go on.
2. CGK walks embed every item-sized window that is left, starting at each word;
   repeated bit sampling looks its keys up among the items' keys. Walks drift apart
   with the number of edits, so items above ``PIECE`` words are embedded as pieces of
   at most that many; if an item is within its edits, one of its pieces at least is
   within its own share of them. With the default walks and tables, at least 0.99
   of stretches at the limit share a key, at any length (measured in the tests).
3. Each candidate is verified by exact edit distance, which also gives its place; a
   piece first by itself, then with its whole item.

The benchmark is sent to the workers in blocks of at most ``block_items`` items,
one pass over the documents per block, so what is broadcast has a bound.
Documents never leave their rows: no shuffle.

Cases: null and empty texts hold nothing; null or empty items, and items below
``least_words`` words (which ordinary prose repeats by chance), are held by
nothing. Null ids stay null. Repeated documents are reported as often as they
occur; repeated items each by themselves. Texts of any length are read whole. With
no documents or no items there are no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import narrow
from ledgerloom.llm.edit_lsh import Walks, best_stretch, fit

WORD = re.compile(r"\w+")
SIMILARITY, LEAST_WORDS, PIECE = 0.8, 5, 59
_HASHED = 1 << 20
_BATCH_WORDS = 1 << 18


class Numbers(dict):
    """Word to number in the benchmark's vocabulary, 0 for all others; remembers spellings it has met."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = number = self.vocabulary.get(word.lower(), 0)
        return number


class Items:
    """One block of the benchmark, ready for search."""

    def __init__(self, items: list[tuple], similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, walks: Walks | None = None):
        self.walks = walks or Walks(walks=6, tables=6, coordinates=2)
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words = [], []
        for item_id, text in items:
            found = [w.lower() for w in WORD.findall(text or "")]
            if len(found) >= least_words:
                self.ids.append(item_id)
                self.words.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found])
        allowed = lambda words: int((1 - similarity) * len(words) + 1e-9)
        self.edits = [allowed(w) for w in self.words]
        self.pieces = []  # (item, its words before the piece, words, edits)
        for i, w in enumerate(self.words):
            count = -(-len(w) // PIECE)
            cuts = [len(w) * c // count for c in range(count + 1)]
            self.pieces += [(i, a, w[a:b], allowed(w[a:b])) for a, b in zip(cuts, cuts[1:])]
        self.pairs = np.zeros(_HASHED, dtype=bool)
        for w in self.words:
            self.pairs[_pair_hash(np.array(w[:-1]), np.array(w[1:]))] = True
        by_size = defaultdict(list)
        for i, (_, _, w, _) in enumerate(self.pieces):
            by_size[(len(w) - 1).bit_length() * 2 + (len(w) - 1 >= 3 << max(0, (len(w) - 1).bit_length() - 2))].append(i)
        self.classes = []
        for members in by_size.values():
            words, edits = [self.pieces[i][2] for i in members], [self.pieces[i][3] for i in members]
            steps = max(self.walks.coordinates, int(1.6 * min(map(len, words))))
            line = np.concatenate([[*w, *[0] * (steps + 1)] for w in words]).astype(np.int64)
            starts = np.cumsum([0, *[len(w) + steps + 1 for w in words]])[:-1]
            keys = self.walks.keys(line, starts, steps)
            tables = []
            for row in keys:
                order = np.argsort(row, kind="stable")
                tables.append((row[order], np.array(members)[order]))
            reach = max(len(w) + k for w, k in zip(words, edits))
            need = min(len(w) - 1 - 2 * k for w, k in zip(words, edits))
            self.classes.append((steps, reach, need, tables))
        self.pad = max([steps + 1 for steps, _, _, _ in self.classes] + [r for _, r, _, _ in self.classes], default=0)

    def candidates(self, line: np.ndarray) -> dict[int, set[int]]:
        """Places in ``line`` (padded at its end) and the pieces whose keys they share."""
        found: dict[int, set[int]] = defaultdict(set)
        hits = np.zeros(len(line) + 1, dtype=np.int32)
        both = (line[:-1] > 0) & (line[1:] > 0)
        both &= self.pairs[_pair_hash(line[:-1], line[1:])]
        np.cumsum(both, out=hits[1 : len(both) + 1])
        hits[len(both) + 1 :] = hits[len(both)]
        last = len(line) - self.pad
        for steps, reach, need, tables in self.classes:
            ends = np.minimum(np.arange(last) + reach - 1, len(hits) - 1)
            starts = np.flatnonzero(hits[ends] - hits[:last] >= need)
            for a in range(0, len(starts), _BATCH_WORDS):
                part = starts[a : a + _BATCH_WORDS]
                for key, (own, members) in zip(self.walks.keys(line, part, steps), tables):
                    low, high = np.searchsorted(own, key, "left"), np.searchsorted(own, key, "right")
                    for i in np.flatnonzero(high > low).tolist():
                        found[int(part[i])].update(members[low[i] : high[i]].tolist())
        return found

    def search(self, texts: list[list[int]]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first word, end word) of the best stretch of every text that holds an item."""
        if not self.words:
            return []
        gap = [0] * self.pad
        line = np.array([n for words in texts for n in (*words, *gap)], dtype=np.int64)
        begins = np.cumsum([0, *[len(words) + self.pad for words in texts]])
        regions: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        places = self.candidates(line)
        for place in sorted(places):
            text = int(np.searchsorted(begins, place, "right")) - 1
            at = place - int(begins[text])
            for piece in places[place]:
                item, before, words, share = self.pieces[piece]
                k, n = self.edits[item], len(self.words[item])
                if len(words) < n and fit(words, texts[text][max(0, at - share) : at + len(words) + 2 * share])[0] > share:
                    continue
                low = max(0, at - share - (before + k if before else 0))
                regions[text, item].append((low, min(len(texts[text]), at + n - before + k + share)))
        out = []
        for (text, item), kept in regions.items():
            best, apart = None, []
            for low, high in sorted(kept):
                if apart and low <= apart[-1][1]:
                    apart[-1][1] = max(apart[-1][1], high)
                else:
                    apart.append([low, high])
            for low, high in apart:
                edits, a, b = best_stretch(self.words[item], texts[text][low:high])
                if edits <= self.edits[item] and (best is None or edits < best[0]):
                    best = (edits, low + a, low + b)
            if best:
                out.append((text, item, *best))
        return sorted(out)


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(44)).astype(np.int64)


def blocks(benchmark: DataFrame, id: str = "item_id", text: str = "text", block_items: int = 20_000, **options) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_items`` items."""
    rows = narrow(benchmark, item_id=id, text=text)
    count = max(1, -(-rows.count() // block_items))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for b in range(count):
        yield Items([(r[0], r[1]) for r in rows.filter(block == b).orderBy("item_id", "text").collect()], **options)


def _in_batches(texts: list[str | None], numbers: Numbers) -> Iterator[tuple[int, list[list[int]]]]:
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append([numbers[w] for w in WORD.findall(text or "")])
        size += len(held[-1])
        if size >= _BATCH_WORDS:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """One row per document and item it holds: ``doc_id, item_id, start, end, edits, similarity``; start and end are code points."""
    rows = narrow(docs, doc_id=id, text=text)
    kinds = [rows.schema["doc_id"].dataType, benchmark.schema[item_id].dataType]
    schema = T.StructType([
        T.StructField("doc_id", kinds[0]), T.StructField("item_id", kinds[1]), T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("similarity", T.DoubleType()),
    ])
    out = None
    for items in blocks(benchmark, item_id, item_text, **options):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block, numbers = sent.value, Numbers(sent.value.vocabulary)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                found = []
                for first, numbered in _in_batches(texts, numbers):
                    for t, i, edits, a, b in block.search(numbered):
                        spans = [m.span() for m in WORD.finditer(texts[first + t])][a:b]
                        found.append((ids[first + t].as_py(), block.ids[i], spans[0][0], spans[-1][1], edits, 1 - edits / len(block.words[i])))
                if found:
                    columns = list(zip(*found))
                    types = [batch.schema.field(0).type, None, pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _holds(sent):
    @F.pandas_udf(T.BooleanType())
    def holds(texts: pd.Series) -> pd.Series:
        numbers = Numbers(sent.value.vocabulary)
        held = np.zeros(len(texts), dtype=bool)
        for first, numbered in _in_batches(texts.tolist(), numbers):
            for t, *_ in sent.value.search(numbered):
                held[first + t] = True
        return pd.Series(held)

    return holds


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    for items in blocks(benchmark, item_id, item_text, **options):
        holds = _holds(docs.sparkSession.sparkContext.broadcast(items))
        docs = docs.filter(~holds(docs[text]))
    return docs
