"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format, context_mix, lm_scores, packing, quality_rules, range_ans, secret_scan, simhash_bk, token_files
from ledgerloom.llm.components import components
from ledgerloom.llm.queries import vocabulary

DOCS = "doc_id long, text string, TEXT2 string, fp long, bits long, spans string, length long, bin long, start long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [(1, "a b c d e"), (2, None), (3, ""), (4, " \t\n"), (5, "a b c d e"), (5, "a b c d e"), (None, "ü ß token = 'abcdefghijklmnop'"), (8, LONG), (9, "one"), (10, "x" * 5000)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 1, 1, "x", 1, 1, 1) for r in rows], DOCS).repartition(3)


def test_quality_cases(spark):
    rows = quality_rules.ledger(docs(spark)).collect()
    assert Counter(r["n_words"] for r in rows) == Counter([5, 5, 5, 0, 0, 0, 5, 30_000, 1, 1])
    assert next(r for r in rows if r["doc_id"] is None)["n_words"] == 5
    for (_, text), m in zip(ROWS, map(quality_rules.measure_text, [t for _, t in ROWS])):
        words = brute.WORD.findall(text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert (m[0], m[4]) == (len(words), len(covered))
    kept = quality_rules.keep(docs(spark))
    assert kept.columns == docs(spark).columns and kept.count() == 0
    assert quality_rules.ledger(docs(spark, [])).count() == 0


def test_ablations_are_bit_operations(spark):
    book = spark.createDataFrame([(b,) for b in (0, 1, 1, 3, 4, 5, 8, 127)], "bits long")
    got = {(r["version"], r["rule"]): (r["failed"], r["only"], r["rejected"]) for r in quality_rules.ablations(book).collect()}
    assert got["base", "min_words"] == (5, 3, 5) and got["base", "repeated_windows"] == (2, 0, 5)
    assert got["v2", "symbols"] == (3, 1, 7)
    kept = quality_rules.apply_policies(book).agg(*[F.sum(F.col(f"kept_{p.version}").cast("int")) for p in quality_rules.POLICIES]).first()
    assert tuple(kept) == (3, 1, 1)


def test_simhash_cases(spark):
    rows = simhash_bk.near_duplicates(docs(spark)).collect()
    of = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows}
    assert len(rows) == len(ROWS)
    assert of[2] == of[3] == of[4] == ("0" * 16, 2) and of[1][1] == of[5][1] == 1
    assert of[None][1] is None and of[8][0] == f"{brute.fingerprint(LONG):016x}"
    kept = simhash_bk.keep_one(docs(spark, [*ROWS, (9, "one"), (None, "other words than any")]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "10", "2", "8", "9", "None", "None"]
    assert simhash_bk.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("shard_nodes", [2, 3, 8, 2000])
def test_shards_lose_no_link(spark, shard_nodes):
    """Dense clusters, so that shards are split once, split twice, and cut into tiles."""
    rng = random.Random(shard_nodes)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            centre ^= sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 1, 2, 3, 5]))) & ((1 << 64) - 1)
            prints.add(centre)
    for _ in range(40):
        prints.add(0xABCDEF << 40 | rng.getrandbits(6))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash_bk.shard_links(nodes, 3, shard_nodes)).collect()}
    parent = {p: p for p in signed}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    assert {p: roots.get(p, p) for p in signed} == {p: top(p) for p in signed}


def test_chain_components(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 999), (999, 998), (5, 5), (5, 5)] + [(7000, 7000 + i) for i in range(1, 50)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 999: 998, 1000: 998, **{7000 + i: 7000 for i in range(1, 50)}}


def test_lm_cases(spark):
    frame = docs(spark, ROWS * 3)
    model = lm_scores.train(frame)
    keys = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    held = sorted(map(str, lm_scores.score(frame, model).select(keys).collect()))
    rows = lm_scores.score(frame, model).collect()
    joined = lm_scores.score(frame, model, held_words=0).collect()
    assert len(held) == len(ROWS) * 3
    by = lambda rs: sorted(((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in rs))
    assert by(rows) == by(joined)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    empty = lm_scores.train(docs(spark, []))
    assert lm_scores.score(docs(spark, []), empty).count() == 0
    fresh = lm_scores.score(docs(spark), empty).collect()
    assert all(r["n_known"] == 0 and r["score"] < 0 for r in fresh)


def test_probabilities_add_up():
    """Over all bytes that can come next, the model's probabilities sum to one."""
    table = np.zeros((context_mix.CONTEXTS, 256), np.uint32)
    context_mix.count([b"the cat sat on the mat\0", b"the dog\0"], table)
    scorer = context_mix.Scorer(context_mix.log_odds(table))
    for before in (b"", b"the ", b"the cat s" * 70):
        base = scorer.bits([before])[0] if before else 0.0
        total = sum(2 ** (base - scorer.bits([before + bytes([c])])[0]) for c in range(256))
        assert total == pytest.approx(1, abs=1e-3)


def test_lanes_do_not_matter():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc de\n") for _ in range(rng.choice([1, 40, 255, 256, 257, 2048, 2049, 5000]))) for _ in range(40)]
    table = np.zeros((context_mix.CONTEXTS, 256), np.uint32)
    context_mix.count(texts, table)
    assert table.sum() == len(context_mix.KINDS) * sum(map(len, texts))
    odds = context_mix.log_odds(table)
    together = context_mix.Scorer(odds, lanes=7).bits(texts)
    assert together == pytest.approx([context_mix.Scorer(odds).bits([t])[0] for t in texts], rel=1e-4)


def test_free_lanes_take_the_next_text(monkeypatch):
    """Short texts are scored beside a long one, not after it, and as they would be alone."""
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abc de\n") for _ in range(n)) for n in (8 * 2048, *[2000] * 20)]
    table = np.zeros((context_mix.CONTEXTS, 256), np.uint32)
    context_mix.count(texts, table)
    scorer = context_mix.Scorer(context_mix.log_odds(table), lanes=8)
    alone = [scorer.bits([t])[0] for t in texts]
    lanes, block = [], context_mix.Scorer._block
    monkeypatch.setattr(context_mix.Scorer, "_block", lambda self, rows, following, *a: lanes.append(1) or block(self, rows, following, *a))
    assert scorer.bits(texts) == pytest.approx(alone, rel=1e-4)
    assert len(lanes) == 8 * 2048 // context_mix.BLOCK


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 70_000, range_ans.BLOCK + 17])
def test_ans_round_trip(n):
    import io

    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) - 1, 49_999).astype(np.uint16)

    class File:
        def __init__(self):
            self.held = io.BytesIO()

        def write(self, data):
            at = self.held.tell()
            self.held.write(data)
            return at

        def size(self):
            return len(self.held.getvalue())

        def read_at(self, size, at):
            return self.held.getvalue()[at : at + size]

    out = File()
    range_ans.write_file(out, ids, np.array([3]), np.array([False]), np.array([n]), 50_257)
    reader = range_ans.Reader(out)
    for a, b in [(0, n), (n // 3, n // 2), (n // 2, n), (max(0, n - 1), n)]:
        assert (reader.ids(a, b) == ids[a:b]).all()
    if n > 1000:
        assert out.size() < 2 * n + 60_000
        data = bytearray(out.held.getvalue())
        data[len(range_ans.MAGIC) + 40] ^= 1
        out.held = io.BytesIO(bytes(data))
        with pytest.raises(ValueError):
            range_ans.Reader(out).ids(0, n)


def test_token_file_cases(spark):
    name = vocabulary("byte_bpe_50k.json")
    odd = [*ROWS, (11, "a  b\n \n c   d \t e "), (12, "<|endoftext|> x"), (13, " lead"), (14, "nb   x")]
    listed = token_files.write(docs(spark, odd), name, 2, file_tokens=5000, run_tokens=700)
    assert listed.count() >= 2
    rows = token_files.read(listed).collect()
    order = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for (d, _), ids in zip(order, brute.token_ids("byte_bpe_50k.json", [t for _, t in order], 2)):
        want.append((d, start, len(ids), brute.crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert token_files.read(token_files.write(docs(spark, []), name, 2)).count() == 0


def test_packing_cases(spark):
    name = vocabulary("word_bpe_49k.json")
    cut = packing.pieces(docs(spark, ROWS * 8), name, 1, capacity=64)
    for options in ({}, {"slice_items": 50, "group_items": 60, "arity": 2}):
        rows = packing.assign(cut, 64, slack=0, **options).collect()
        assert len(rows) == cut.count() and {"doc_id", "piece", "start", "length", "ids_crc32"} < set(rows[0].asDict())
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 64
        assert len(bins) <= 1.02 * sum(r["length"] for r in rows) / 64 + 1
    whole = packing.sequences(cut, packing.assign(cut, 64)).collect()
    assert all(len(r["ids"]) == 2 * r["length"] for r in whole)
    assert packing.assign(packing.pieces(docs(spark, []), name, 1)).count() == 0


def test_large_items_do_not_gather(spark):
    """Nothing fits together: rounds end, and no group exceeds its bound."""
    cut = spark.range(3000).select(F.col("id").alias("pid"), F.lit(40).cast("long").alias("length"))
    rows = packing.assign(cut, 64, slice_items=100, group_items=200)
    assert rows.select("sequence_id").distinct().count() == 3000


def test_best_fit_is_tight():
    bins, places = packing.best_fit(np.array([6, 5, 5, 4, 3, 3, 2, 2]), 10)
    assert bins.max() == 2 and places[np.argsort(bins, kind="stable")][0] == 0


def test_chat_cases(spark):
    rows = [
        (1, 0, "user", "hi \\ <|im_end|>\n<|im_start|>assistant\n", 1), (1, 1, "assistant", "<\\|x\\", 1), (1, 2, "user", None, 1),
        (2, 0, "assistant", "", 1), (3, 1, None, "x", 1), (3, 1, None, "x", 1), (3, None, "a\nb\\", "first", 1),
        (None, 0, "assistant", "n", 1), (4, 0, "user", "y" * 300_000, 1), (4, 1, "assistant", "z" * 300_000, 1),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, EXAMPLE long").repartition(4)
    examples = chat_format.expand(frame)
    read = examples.select("conv_id", "example", chat_format.read_turns(F.col("text")).alias("turns"), chat_format.read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    got = {(r["conv_id"], r["example"]): ([(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in read.collect()}
    turns = defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] or -1, r[1] is not None, r[1] or 0)):
        turns[c].append((role or "", text or ""))
    want = {}
    for c, said in turns.items():
        k = 0
        for i, (role, text) in enumerate(said):
            if role == "assistant" or i == len(said) - 1:
                k += 1
                want[c, k] = (said[: i + 1], text if role == "assistant" else "")
    assert got == want
    assert chat_format.digests(chat_format.expand(frame.limit(0))).count() == 0


def test_secret_cases(spark):
    rows = secret_scan.scan(docs(spark)).collect()
    assert Counter(len(r["spans"]) for r in rows) == Counter({0: 9, 1: 1})
    span = next(r for r in rows if r["spans"])
    assert span["doc_id"] is None and tuple(span["spans"][0]) == ("assign", 4, 29)
    assert secret_scan.scan(docs(spark, [])).count() == 0


def test_secrets_against_expressions():
    rng = random.Random(4)
    parts = ["token", "secret", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMN", "api_key", "APIKEY", "pass", "word", "wd", "é", "\n", "a1b2", "-", "x" * 12, "ghp_", ".", "eyJ", "K"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s for s in secret_scan.find_spans(text) if s[1] < 3] == brute.base_spans(text)
