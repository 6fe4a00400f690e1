"""Surrogates: format, type, gender, script, coreference, distinctness, and clean texts left alone."""

import re

import duckdb
from pyspark.sql import functions as F

from ledgerloom.llm import surrogates
from ledgerloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, OWNER_ string, tries_ long"


def replaced(spark, texts, key="k"):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    out = surrogates.replace(spark.createDataFrame(rows, SCHEMA).repartition(3), key, counted="n")
    assert out.columns == ["doc_id", "text", "OWNER_", "tries_", "n"]
    return {r["doc_id"]: r["text"] for r in out.collect()}


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def test_shapes_and_coreference(spark):
    out = replaced(spark, [
        "a Hein.19@mail5.example.com, hein.19@MAIL5.example.com. z",
        "+1 (743) 555-3824 or +1 743 555 3824; 743-555-3824",
        "4111 1111 1111 1111, 4111111111111111, 4785380592391139, 123-45-6789",
        "152.143.123.131 and 152.143.123.131, not 999.1.1.1 or 1.2.3",
        "Mrs. Maria Smith, Mr. John Smith, Mr Smith; Frau MÜLLER-LUDENSCHEIDT",
        "Господин Иван Иванов, Госпожа Иванова",
        "2020 2021 2022, token = f33e61083db5dbdf4bd2369d2f80176e57f7 v1.2.3 The Mr. is",
    ])
    first, second = re.fullmatch(r"a (\w+\.\d\d@\w{4}\d\.\w{7}\.com), (\w+\.\d\d@\w{4}\d\.\w{7}\.com)\. z", out[0]).groups()
    assert first.lower() == second.lower() != "hein.19@mail5.example.com" and first[0].isupper()
    a, b, c = re.fullmatch(r"\+1 \((\d{3})\) (\d{3}-\d{4}) or \+1 (\d{3} \d{3} \d{4}); \d{3}-\d{3}-\d{4}", out[1]).groups()
    assert re.sub(r"\D", "", a + b) == re.sub(r"\D", "", c) != "7435553824"
    cards = re.fullmatch(r"(4\d{3} \d{4} \d{4} \d{4}), (4\d{15}), (4\d{15}), (\d{3}-\d{2}-\d{4})", out[2]).groups()
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111"
    assert luhn(cards[0]) and luhn(cards[2]) == luhn("4785380592391139")
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", out[3])
    assert ips[0] == ips[1] != "152.143.123.131" and ips[2] == "999.1.1.1"
    assert all(int(o) < 256 for o in ips[0].split("."))
    maria, one, john, two, three, frau = re.fullmatch(r"Mrs\. (\w+) (\w+), Mr\. (\w+) (\w+), Mr (\w+); Frau (\w+)", out[4]).groups()
    assert one == two == three != "Smith" and maria.endswith("a") and not john.endswith("a") and frau.isupper()
    ivan, ivanov, lady = re.fullmatch(r"Господин (\w+) (\w+), Госпожа (\w+)", out[5]).groups()
    assert all(re.fullmatch("[А-Я][а-я]+", w) for w in (ivan, ivanov, lady)) and ivanov != lady
    assert out[6].startswith("2020 2021 2022, token = f33e61083db5dbdf4bd2369d2f80176e57f7 v1.2.3")


def test_key_decides(spark):
    texts = ["x@y.example.com 10.1.2.3"]
    assert replaced(spark, texts, "k") == replaced(spark, texts, "k") != replaced(spark, texts, "other")


def test_collisions_are_settled(spark):
    """Names of two letters have far more originals than one attempt has room for."""
    texts = [f"{a}{b}@{d}.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789" for d in ("x", "y")] * 2
    out = replaced(spark, texts)
    pairs = {(t, out[i]) for i, t in enumerate(texts)}
    assert len(pairs) == len({new for _, new in pairs}) == len(set(texts))
    assert not {new for _, new in pairs} & set(texts)


def test_cases(spark):
    out = replaced(spark, [None, "", "word " * 100_000 + "10.1.2.3", "1.2.3.4" * 0])
    assert out[0] is None and out[1] == "" and len(out[2]) >= 500_000 and "10.1.2.3" not in out[2]
    assert surrogates.replace(spark.createDataFrame([], SCHEMA), "k").count() == 0
    rows = surrogates.replace(spark.createDataFrame([(None, "10.1.2.3", "", 0), (None, "10.1.2.3", "", 0)], SCHEMA), "k").collect()
    assert rows[0]["text"] == rows[1]["text"] != "10.1.2.3"


def test_query(spark, sf):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    rows = QUERIES["op2_pii_surrogates"](spark, sf)
    assert "Python" not in rows._jdf.queryExecution().toString() and "Pandas" not in rows._jdf.queryExecution().toString()
    found = re.compile(r"[\w.]+@[\w.]+\.\w+|(?<![\w.])\d{16}(?!\w)|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w)")
    new_of = {}
    seen = rows.collect()
    assert sorted(r["doc_id"] for r in seen) == sorted(texts)
    for r in seen:
        old = found.findall(texts[r["doc_id"]])
        assert r["n_entities"] == len(old)
        if not old:
            assert r["text"] == texts[r["doc_id"]]
        for a, b in zip(old, found.findall(r["text"]), strict=True):
            assert new_of.setdefault(a, b) == b != a and len(a) - 8 <= len(b) <= len(a) + 8
    assert len(set(new_of.values())) == len(new_of) > 10
