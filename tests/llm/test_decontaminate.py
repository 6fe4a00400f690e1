"""Edit distance, recall of the walks, and whole results against brute force."""

import random
import re

import duckdb
import pytest
from pyspark.sql import Row

from ledgerloom.llm import decontaminate, edit_lsh
from ledgerloom.llm.queries import QUERIES


def fitting(pattern, text):
    """Least edits of the pattern against any stretch of the text, by the plain table."""
    before = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (p != t)))
        before = now
    return min(before)


def test_best_stretch():
    rng = random.Random(3)
    for _ in range(300):
        p = [rng.randint(1, 4) for _ in range(rng.randint(1, 12))]
        t = [rng.randint(1, 4) for _ in range(rng.randint(0, 25))]
        edits, a, b = edit_lsh.best_stretch(p, t)
        assert edits == fitting(p, t) == fitting(p, t[a:b])


def edited(rng, words, edits, others):
    out = list(words)
    for _ in range(edits):
        kind, at = rng.choice("sid"), rng.randrange(len(out))
        if kind == "s":
            out[at] = rng.choice(others)
        elif kind == "d":
            del out[at]
        else:
            out.insert(at, rng.choice(others))
    return out


def test_recall_at_the_limit():
    items = duckdb.sql("SELECT item_id, text FROM '/root/testdata/sf0.1/benchmark.parquet'").fetchall()
    block = decontaminate.Items(items)
    rng = random.Random(5)
    others = [0, 0, *block.vocabulary.values()]
    met = 0
    for i, words in enumerate(block.words):
        around = [[rng.choice(others) for _ in range(40)] for _ in range(2)]
        text = around[0] + edited(rng, words, block.edits[i], others) + around[1]
        met += any(r[1] == i for r in block.search([text]))
    assert met >= 0.99 * len(block.words)


def test_query_is_brute_force(spark, sf):
    """Every pair of documents and items, over the whole small tables."""
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    words = lambda t: re.findall(r"\w+", t.lower())
    pairs = lambda w: set(zip(w, w[1:]))
    want = {}
    for i, text in items:
        item = words(text)
        k = int(0.2 * len(item) + 1e-9)
        for d, t in docs:
            doc = words(t)
            if len(pairs(item) & pairs(doc)) >= len(pairs(item)) - 2 * k and (edits := fitting(item, doc)) <= k:
                want[d, i] = edits
    rows = QUERIES["op1_cgk_decontamination"](spark, sf).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in rows} == want and len(rows) == len(want) > 0


def test_cases(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [
        Row(doc_id=1, text=f"İ before, {item.upper()}! after", ITEM_ID=0),
        Row(doc_id=2, text=item.replace("five", "5").replace("eight ", ""), ITEM_ID=0),
        Row(doc_id=3, text="one two three four five", ITEM_ID=0),
        Row(doc_id=4, text=None, ITEM_ID=0),
        Row(doc_id=5, text="", ITEM_ID=0),
        Row(doc_id=None, text=item, ITEM_ID=0),
        Row(doc_id=7, text="x " * 200_000 + item, ITEM_ID=0),
        Row(doc_id=1, text=f"İ before, {item.upper()}! after", ITEM_ID=0),
        Row(doc_id=8, text=" ".join(item.split()[1:]), ITEM_ID=0),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string, ITEM_ID long")
    bench = spark.createDataFrame([("a", item), ("b", item), ("c", None), ("d", ""), ("e", "too short")], "item_id string, text string")
    for size in (1, 2, 100):
        rows = decontaminate.matches(frame, bench, block_items=size).collect()
        assert sorted((str(r["doc_id"]), r["item_id"], r["edits"]) for r in rows) == sorted(
            (d, i, e) for i in "ab" for d, e in (("1", 0), ("1", 0), ("2", 2), ("None", 0), ("7", 0), ("8", 1))
        )
    span = next(r for r in rows if r["doc_id"] == 1)
    assert docs[0].text[span["start"] : span["end"]] == item.upper()
    left = decontaminate.clean(frame, bench)
    assert left.columns == frame.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5]


@pytest.mark.parametrize("which", ["docs", "bench"])
def test_empty(spark, which):
    docs = spark.createDataFrame([(1, "a b c d e f g")] if which == "bench" else [], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "a b c d e f g")] if which == "docs" else [], "item_id string, text string")
    assert decontaminate.matches(docs, bench).count() == 0
    assert decontaminate.clean(docs, bench).count() == docs.count()
