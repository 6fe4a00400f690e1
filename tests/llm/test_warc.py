"""Archives, loser tree and global order of captures."""

import base64
import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import Row

from ledgerloom.llm import warc_archive, warc_records
from ledgerloom.llm.queries import QUERIES


def expected(pages, least=0):
    groups = defaultdict(list)
    for p, html in pages:
        groups[(html or "").encode()].append(p)
    out = {}
    for body, ids in groups.items():
        whole = max(ids)
        for p in ids:
            again = p != whole and len(body) >= least
            out[p] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", whole if again else None)
    return out


def found(rows):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows}


def test_query(spark, sf):
    rows = QUERIES["op4_warc_index_merge"](spark, sf).collect()
    pages = duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall()
    assert found(rows) == expected(pages) and len(rows) == len(pages)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(40) for _ in range(rng.choice([0, 1, 7, 30]))) for _ in range(k)]
    assert list(warc_archive.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_cases_and_order(spark):
    hot = [Row(page_id=i, url="http://WWW.hot.example/a?b=1#f", html="same" if i % 3 else None, URL2="x") for i in range(60)]
    odd = [
        Row(page_id=100, url=None, html="", URL2="x"),
        Row(page_id=None, url="nonsense\r\nX: y", html="ü" * 50_000 + "\r\n\r\nWARC/1.1\r\n", URL2=None),
        Row(page_id=101, url="https://é.example:8080/Ü", html="one", URL2=None),
        Row(page_id=101, url="https://é.example:8080/Ü", html="one", URL2=None),
    ]
    pages = spark.createDataFrame(hot + odd, "page_id long, url string, html string, URL2 string").repartition(5)
    listed = warc_archive.write(pages, file_bytes=600)
    entries = warc_archive.runs(listed)
    rows = warc_archive.merge(entries, range_entries=9).orderBy("part", "at").collect()
    keys = [(r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in rows]
    assert keys == sorted(keys) and len(rows) == 64
    assert len({r["part"] for r in rows}) > 4  # one URL, several ranges
    want = expected([(r.page_id, r.html) for r in hot + odd if r.page_id is not None])
    assert {k: v for k, v in found(rows).items() if k is not None} == want
    nameless = next(r for r in rows if r["page_id"] is None)
    assert warc_archive.payload(nameless.asDict()) == odd[1].html.encode()
    assert nameless["record_type"] == "response"


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    rows = warc_archive.merge(warc_archive.runs(warc_archive.write(pages, least_bytes=3))).collect()
    assert found(rows) == expected([(1, "ab"), (2, "ab"), (3, "abc"), (4, "abc")], 3)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_archive.merge(warc_archive.runs(warc_archive.write(pages))).count() == 0


def test_damage_is_noticed():
    data = warc_records.record(1, "u", b"abc", warc_records.digest(b"abd"), None, False)
    with pytest.raises(ValueError):
        import io

        warc_records.read_record(next(warc_records.members(io.BytesIO(data)))[2])


@pytest.mark.parametrize("url,key", [
    ("http://www.Example.com/A?b#c", "com,example)/a?b"), ("https://m.a.org:443", "org,a,m)/"), ("//x.y:81/z", "y,x:81)/z"), (None, ""), ("no host", "no host"),
])
def test_url_key(url, key):
    assert warc_records.url_key(url) == key
