"""WARC archives of a page table, read back, with a globally ordered capture index.

Pages become gzip-per-record WARC files in the shared folder. Of pages with equal
payloads (of ``least_bytes`` or more) the one with the largest id is stored whole,
the others are revisits of it. Each file is read back into a run of index entries
sorted by (URL key, time, page). Runs are merged by ranges of that key: a range
takes its stretch of every run, and a loser tree picks the next entry among the
heads of all runs. Ranges are cut on the whole key, so a URL with very many
captures spreads over several, and a range holds about ``range_entries`` entries.

Cases: a null html is an empty payload; a null url has an empty key; a null id
never refers and is a response only if no equal payload has an id. Rows that
repeat the largest id are all responses. Pages of any size are written whole, in memory
bounded by the page. An empty table gives no archives and no rows. Only page_id,
url and html are read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import files, warc_records
from ledgerloom.llm.common import narrow, or_empty
from ledgerloom.session import new_path, pin

ENTRY = "url_key string, captured string, page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, path string, offset bigint, length bigint"
_ENTRY = pa.schema([
    (n, pa.string() if kind == "string" else pa.int64()) for n, kind in (field.split() for field in ENTRY.split(", "))
])
_ENTRIES = pa.schema([("run", pa.int64()), ("seq", pa.int64()), *_ENTRY])
#: Equal payloads that are held by every task while pages are written; with more, a shuffled join finds them.
_HELD = 100_000
#: Most tasks that read archives; with more archives than that, a task takes several.
_TASKS = 20_000


def write(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, file_bytes: int = 1 << 26) -> DataFrame:
    """Writes the archives and returns their stored list: ``run, path, records``."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    rows = narrow(pages, page_id=id, url=url, html=html)
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", or_empty(F.col("html")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html"))).withColumn("same", F.octet_length("html") >= least_bytes)
    equal = rows.filter("same").groupBy("sha").agg(F.max("page_id").alias("whole"), F.count("*").alias("n")).filter("n > 1 AND whole IS NOT NULL")
    equal = pin(equal.select("sha", "whole", F.lit(True).alias("same")), "equal-payloads")
    few = equal.limit(_HELD + 1).count() <= _HELD
    joined = rows.join(F.broadcast(equal) if few else equal, ["sha", "same"], "left")
    marked = joined.select("page_id", "url", "html", "whole", (F.col("whole").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("whole"))).alias("revisit"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files.make_folder(folder)
        part, seq, out, records = TaskContext.get().partitionId(), 0, None, 0
        done = []
        for batch in batches:
            for page, address, text, whole, revisit in zip(*[batch.column(k) for k in range(5)]):
                payload = (text.as_py() or "").encode()
                if out is None:
                    out, records = files.Output(folder, f"{part:06d}-{seq:04d}", "warc.gz"), 0
                out.write(warc_records.record(page.as_py(), address.as_py(), payload, warc_records.digest(payload), whole.as_py(), revisit.as_py()))
                records += 1
                if out.size >= file_bytes:
                    out.close()
                    done.append((part << 20 | seq, out.uri, records))
                    out, seq = None, seq + 1
        if out is not None:
            out.close()
            done.append((part << 20 | seq, out.uri, records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["run", "path", "records"])

    return pin(marked.mapInArrow(archive, "run bigint, path string, records bigint"), "warc-list")


def runs(listed: DataFrame) -> DataFrame:
    """Reads every archive from front to back; stored entries, numbered in key order inside their run."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                entries = []
                with files.open_input(row["path"]) as source:
                    for offset, length, data in warc_records.members(source):
                        entry = warc_records.read_record(data)
                        del entry["payload"]
                        entries.append({**entry, "url_key": warc_records.url_key(entry.pop("url")), "path": row["path"], "offset": offset, "length": length})
                if len(entries) != row["records"]:
                    raise ValueError(f"{row['path']} holds {len(entries)} of {row['records']} records")
                entries.sort(key=_key)
                columns = [[e[f.name] for e in entries] for f in _ENTRY]
                numbers = [pa.array([row["run"]] * len(entries), pa.int64()), pa.array(range(len(entries)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*numbers, *[pa.array(c, f.type) for c, f in zip(columns, _ENTRY)]], schema=_ENTRIES)

    tasks = max(1, min(listed.count(), _TASKS))  # a list so short would go to one task
    return pin(listed.repartition(tasks, "path").mapInArrow(index, f"run bigint, seq bigint, {ENTRY}"), "warc-runs")


def _key(e: dict) -> tuple:
    return e["url_key"], e["captured"], e["page_id"] is not None, e["page_id"] or 0, e["offset"]


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next winner replays one path."""

    def __init__(self, sources: list[Iterator], key):
        self.sources, self.key = sources, key
        self.k = len(sources)
        self.heads = [next(s, None) for s in sources]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._settle(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Source a wins over b; ended sources lose, ties go to the lower number."""
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _settle(self, leaf: int) -> None:
        """First fill: a source waits at the first empty node above it; at a full one the loser stays."""
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and self.keys[winner := self.losers[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = head = next(self.sources[winner], None)
            self.keys[winner] = None if head is None else self.key(head)
            node = (winner + self.k) // 2
            while node > 0:
                other = self.losers[node]
                if self._before(other, winner):
                    self.losers[node], winner = winner, other
                node //= 2
            self.losers[0] = winner


def merge(entries: DataFrame, range_entries: int = 100_000) -> DataFrame:
    """All entries with ``part`` and ``at``: ordered by them, captures are in global (URL key, time, page) order."""
    count = entries.count()
    ranges = max(1, -(-count // range_entries))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                stretches.setdefault(row["run"], []).append(row)
        part, at = TaskContext.get().partitionId(), 0
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            nonlocal held, at
            columns = [pa.array([e[f.name] for e in held], f.type) for f in _ENTRY]
            place = [pa.array([part] * len(held), pa.int64()), pa.array(range(at, at + len(held)), pa.int64())]
            at, held = at + len(held), []
            return pa.RecordBatch.from_arrays([*columns, *place], [*_ENTRY.names, "part", "at"])

        for _, entry in LoserTree([((run, e) for e in rows) for run, rows in sorted(stretches.items())], lambda x: _key(x[1])):
            held.append(entry)
            if len(held) == 10_000:
                yield out()
        if held:
            yield out()

    dealt = entries.repartitionByRange(ranges, "url_key", "captured", F.col("page_id").asc_nulls_first(), "offset", "path")
    return dealt.sortWithinPartitions("run", "seq").mapInArrow(merged, f"{ENTRY}, part bigint, at bigint")


def payload(entry: dict) -> bytes:
    """The payload of one response, by its place in the archive."""
    with files.open_input(entry["path"]) as source:
        data = source.read_at(entry["length"], entry["offset"])
    return warc_records.read_record(next(warc_records.members(io.BytesIO(data)))[2])["payload"]
