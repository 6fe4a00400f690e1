"""Session helpers: a local session for tests, and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own, with this package on the workers' path."""
    home = str(Path(__file__).resolve().parent.parent)
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and pinned tables.

    It is the session's ``spark.checkpoint.dir``. Only a local session that has
    none gets a temporary folder of its own; a cluster without the setting is
    an error, because a machine-local folder would lose data with its machine.
    """
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        if app not in _FALLBACK:
            _FALLBACK[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
            spark.sparkContext.setCheckpointDir(_FALLBACK[app])
        folder = _FALLBACK[app]
    return f"{folder.rstrip('/')}/ledgerloom-{app}"


def clear(spark: SparkSession) -> None:
    """Delete what this application stored in the shared folder; frames that read it are void afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def close(spark: SparkSession) -> None:
    """Delete the application's stored tables, then stop the session."""
    clear(spark)
    spark.stop()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


_TIDIED: dict[str, tuple[int, str | None]] = {}
_LOCK = threading.Lock()


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """While this lasts, shuffle files go when the write that made them ends; writes of several threads may overlap."""
    name, app = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark.sparkContext.applicationId
    with _LOCK:
        many, before = _TIDIED.get(app) or (0, spark.conf.get(name, None))
        _TIDIED[app] = many + 1, before
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        with _LOCK:
            many, before = _TIDIED.pop(app)
            if many > 1:
                _TIDIED[app] = many - 1, before
            elif before is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, before)


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and freezes whatever depends on
    how the rows were spread over partitions. What the write shuffled is deleted
    as soon as it ends, not when the driver happens to collect garbage.
    """
    path = new_path(df.sparkSession, label)
    schema = df.schema
    with tidied(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._pinned = path
    return out


def unpin(*frames: DataFrame) -> None:
    """Delete what ``pin`` stored for these frames; only for those that nothing reads any more."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._pinned)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
