"""Tasks that train one model together: a barrier stage whose tasks add up arrays.

Rows are cut into slices of about ``SLICE_ROWS``, at most one per core. Every task
holds its slice in memory and makes passes over it; between passes the tasks add
up their weights. Only such sums travel, never rows. An exchange takes about a
second (Spark looks for the others once a second), so there is one per pass. If
an executor is lost Spark runs the stage again.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Row

#: Rows that one task is meant to hold.
SLICE_ROWS = 1 << 18


def size(df: DataFrame, rows: int) -> int:
    """How many tasks train on so many rows."""
    return max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SLICE_ROWS)))


class Gang:
    """What a task sees of the others."""

    def __init__(self, tasks: int):
        self.tasks = tasks
        self.context = BarrierTaskContext.get()
        self.place = self.context.partitionId()

    def add(self, part: np.ndarray) -> np.ndarray:
        """The sum of this array over all tasks, the same bits in each of them."""
        if self.tasks == 1:
            return part
        said = self.context.allGather(base64.b64encode(np.ascontiguousarray(part, dtype="<f8").tobytes()).decode())
        return np.sum([np.frombuffer(base64.b64decode(s), dtype="<f8").reshape(part.shape) for s in said], axis=0)


def train(rows: DataFrame, tasks: int, work: Callable[[Gang, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, key: str = "row_id") -> list[Row]:
    """Deals ``rows`` to so many tasks by ``key``, in its order, and returns what the first task yields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gang = Gang(tasks)
        for out in work(gang, batches):
            if gang.place == 0:
                yield out

    return rows.repartition(tasks, key).sortWithinPartitions(key).mapInArrow(run, schema, barrier=True).collect()


def matrix(batches: Iterator[pa.RecordBatch], columns: Sequence[str], label: str = "y") -> tuple[np.ndarray, np.ndarray]:
    """A slice as a matrix and its labels."""
    parts, labels = [np.empty((0, len(columns)))], [np.empty(0)]
    for b in batches:
        parts.append(np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(np.float64))
        labels.append(b.column(label).to_numpy(zero_copy_only=False).astype(np.float64))
    return np.concatenate(parts), np.concatenate(labels)
