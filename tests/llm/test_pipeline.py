"""Stages keep what they should, and the whole is the stages one after the other."""

import re
from collections import Counter

import brute
import duckdb
import numpy as np
from test_decontaminate import fitting
from test_shingle_dedup import kept

import corpus_pipeline
from ledgerloom.llm import quality_rules
from ledgerloom.session import pin


def holds(text, item):
    """Whether a text has a stretch within 20 % word edits of the item, by the plain table (texts with too few shared word pairs cannot)."""
    words, wanted = (re.findall(r"\w+", t.lower()) for t in (text, item))
    most, pairs = int(0.2 * len(wanted) + 1e-9), set(zip(wanted, wanted[1:]))
    return len(pairs & set(zip(words, words[1:]))) >= len(pairs) - 2 * most and fitting(wanted, words) <= most


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    state = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        state = pin(stage(spark, state, sf), name)
        assert state.columns == docs.columns
        now = {r["doc_id"]: r["text"] for r in state.collect()}
        if k == 0:
            judged = {d: quality_rules.measure_text(t) for d, t in texts.items()}
            assert set(now) == {d for d, m in judged.items() if not fails(m)}
        if k == 1:
            assert sorted(now) == kept(list(texts.items()))
        if k == 2:
            assert set(now) == {d for d, t in texts.items() if not any(holds(t, item) for _, item in items)}
        if k == 3:
            assert set(now) == set(texts) and any(now[d] != texts[d] for d in now)
            assert not any(re.search(r"@mail\d\.example\.com", t) for t in now.values())
            assert all(r["n_chars"] == len(r["text"]) for r in state.collect())
        texts = now
    rows = corpus_pipeline.STAGES[-1][1](spark, state, sf).collect()
    ids = dict(zip(texts, brute.token_ids("word_bpe_49k.json", list(texts.values()), 1)))
    assert Counter(r["doc_id"] for r in rows) == {d: -(-len(i) // 4096) for d, i in ids.items()}
    packed = {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == brute.crc(own) and np.frombuffer(r["ids"], dtype="<u2").tolist() == own
        packed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in packed.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096
    whole = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(tuple(r) for r in whole.select(*key).collect()) == sorted(tuple(r[c] for c in key) for r in rows)


def fails(m):
    n, chars, symbols, dup, repeated, lines, upper, letters = m
    return (
        n < 50 or 100 * repeated > 50 * n or 10 * symbols > n or 2 * dup > lines or 2 * upper > n or not 2 * n <= chars <= 14 * n or 2 * letters < n
    )
