"""The named queries over a whole small table, against plain versions."""

import hashlib
import math
from collections import Counter, defaultdict

import brute
import duckdb
import pytest
from compare import compare, connect

from ledgerloom.llm import secret_scan
from ledgerloom.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def result(spark, sf, start):
    (name,) = [n for n in QUERIES if n.startswith(start + "_")]
    return brute.rows_of(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf, name):
    assert compare(spark, connect(sf), name, QUERIES[name], ORACLE[name], sf)[2] == "ok"


def test_op3(spark, sf, docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result(spark, sf, "op3")}
    assert got == brute.linked(docs)


def test_op6(spark, sf, docs):
    total, _, score = brute.unigram(docs)
    texts = dict(docs)
    rows = result(spark, sf, "op6")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        n, known, base = score(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, brute.held_out(r["doc_id"]))
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0
    held = "".join(texts[r["doc_id"]] for r in rows if r["held_out"]).encode()
    shares = [n / len(held) for n in Counter(held).values()]
    flat = -sum(p * math.log2(p) for p in shares)  # bits per byte if bytes were independent and their shares known
    bits = -sum(r["score"] for r in rows if r["held_out"]) / math.log10(2)
    assert bits / len(held) < 0.8 * flat


def test_op7(spark, sf, docs):
    rows = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in result(spark, sf, "op7")}
    want, start = {}, 0
    for (d, _), ids in zip(docs, brute.token_ids("byte_bpe_50k.json", [t for _, t in docs], 2)):
        want[d] = (start, len(ids), brute.crc(ids))
        start += len(ids)
    assert rows == want


def test_op8(spark, sf, docs):
    rows = result(spark, sf, "op8")
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for (d, _), ids in zip(docs, brute.token_ids("word_bpe_49k.json", [t for _, t in docs], 1)):
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[d, k // 4096] = (k, len(part), brute.crc(part))
    assert got == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_op10(spark, sf, docs):
    rows = {r["doc_id"]: r for r in result(spark, sf, "op10")}
    names = [r.name for r in secret_scan.RULES]
    for d, t in docs:
        spans = brute.base_spans(t or "")
        r = rows[d]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        line = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) <= set(r["spans"].split(",")) or not spans
