"""Token ids of a corpus in coded files, in ascending id order, and reading them back.

Texts are range-partitioned and sorted by id; each task encodes its range and
writes files of a bounded number of tokens, so memory does not grow with the
partition. File names are unique per attempt and only a finished task reports
its files, so lost or repeated tasks leave no trace in the result. Reading is
dealt out in runs of whole documents, each begun at the nearest checkpoint.

Cases: a null text is empty and has the end id alone. Null ids come first. Rows
that repeat an id stay, ordered by text. A text of any length is encoded whole;
one that is longer than ``file_tokens`` makes its file longer. An empty table
gives no files and no rows. Only id (an integer) and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import files, range_ans
from ledgerloom.llm.common import narrow
from ledgerloom.llm.tokens import as_u32, encoder
from ledgerloom.session import new_path, pin

#: Most tasks that read back; with more runs than that, a task takes several.
_TASKS = 20_000
FILES = "part bigint, seq bigint, path string, n_docs bigint, n_tokens bigint, runs array<struct<doc:bigint,docs:bigint,token:bigint,tokens:bigint>>"


def _runs(lengths: np.ndarray, most: int) -> list[dict]:
    """Consecutive documents in runs of about ``most`` tokens."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    cuts = np.flatnonzero(np.diff(starts // most, prepend=-1))
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(lengths)]):
        out.append({"doc": int(a), "docs": int(b - a), "token": int(starts[a]), "tokens": int(ends[b - 1] - starts[a])})
    return out


def write(docs: DataFrame, vocabulary: str, end_id: int, id: str = "doc_id", text: str = "text", file_tokens: int = 1 << 23, run_tokens: int = 1 << 20) -> DataFrame:
    """Writes the files and returns their stored list: one row per file, in order of (part, seq)."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files.make_folder(folder)
        model = encoder(vocabulary)
        size, part, seq = model.model.get_vocab_size(), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        tokens = 0
        end = np.array([end_id], dtype=model.dtype).tobytes()

        def flush() -> pa.RecordBatch:
            nonlocal held, tokens, seq
            ids = np.frombuffer(b"".join([packed for _, packed in held]), dtype=model.dtype)
            lengths = np.array([len(packed) // model.dtype.itemsize for _, packed in held], dtype=np.int64)
            nulls = np.array([d is None for d, _ in held])
            names = np.array([d or 0 for d, _ in held], dtype=np.int64)
            out = files.Output(folder, f"{part:06d}-{seq:04d}", "ids")
            range_ans.write_file(out, ids, names, nulls, lengths, size)
            out.close()
            row = {"part": part, "seq": seq, "path": out.uri, "n_docs": len(held), "n_tokens": len(ids), "runs": _runs(lengths, run_tokens)}
            held, tokens, seq = [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([
            ("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
            ("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("doc", "docs", "token", "tokens")]))),
        ])
        for batch in batches:
            for d, packed in zip(batch.column(0).to_pylist(), model.encode_many(t.as_py() for t in batch.column(1))):
                packed += end
                held.append((d, packed))
                tokens += len(packed) // model.dtype.itemsize
                if tokens >= file_tokens:
                    yield flush()
        if held:
            yield flush()

    rows = narrow(docs, doc_id=id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return pin(ordered.mapInArrow(encode, FILES), "token-file-list")


def read(listed: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files.

    ``start`` counts the ids of all documents before; the running sum is over
    files, of which there are tokens / ``file_tokens``, not over documents.
    """
    before = F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    placed = listed.select("path", "runs", F.coalesce(before, F.lit(0)).alias("before"))
    runs = placed.select("path", "before", F.explode("runs").alias("r")).select("path", "before", "r.*")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input(row["path"]) as source:
                    reader = range_ans.Reader(source)
                    first, docs = row["doc"], row["docs"]
                    lengths = reader.lengths[first : first + docs]
                    ids = reader.ids(row["token"], row["token"] + row["tokens"]).astype("<u4")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.doc_ids[first : first + docs], mask=reader.doc_nulls[first : first + docs]),
                        pa.array(ends - lengths + row["token"] + row["before"]),
                        pa.array(lengths),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    tasks = listed.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]  # so few bytes that Spark would put all into one task
    return runs.repartition(max(1, min(tasks, _TASKS)), "path", "doc").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
