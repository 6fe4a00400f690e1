"""Reading and writing ledgers, result tables and line logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import tidied
from ledgerloom.sources.conform import conform
from ledgerloom.sources.ledger import LEDGER

# row_id is assigned at ingest, files do not have to carry it
FILE_COLUMNS = [f for f in LEDGER.fields if f.name != "row_id"]
ACTIVITY = T.StructType(
    [
        T.StructField("ts", T.DoubleType()),
        T.StructField("tool", T.StringType()),
        T.StructField("args", T.MapType(T.StringType(), T.StringType())),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ledger CSV with header: known columns get their ledger type, by name.

    The types come from the ledger schema, so no pass over the data guesses them.
    """
    kinds = {f.name: f.dataType for f in LEDGER.fields}
    names = _header(spark, path)
    schema = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    return spark.read.schema(schema).option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Read by extension: .parquet and .pq are Parquet, everything else is CSV."""
    return read_parquet(spark, path) if path.lower().rstrip("/").endswith((".parquet", ".pq")) else read_csv(spark, path)


def ingest_ledger(spark: SparkSession, path: str, order: Sequence[str] = ()) -> DataFrame:
    """A foreign ledger file in canonical form, numbered in (step, source order).

    `order` names columns that give rows of one hour a fixed order; by default
    all columns do, so that the numbering does not depend on file splits.
    """
    from ledgerloom.operators.blocks import global_index

    raw = load_ledger(spark, path)
    if "row_id" in raw.columns:
        return conform(raw)
    keys = ["step", *(order or [f.name for f in FILE_COLUMNS if f.name in raw.columns and f.name != "step"])]
    return conform(global_index(raw, keys))


def write_ledger(df: DataFrame, path: str, partition: bool = True) -> None:
    """Write by extension; Parquet is laid out by year so that year filters skip folders."""
    if path.lower().rstrip("/").endswith((".parquet", ".pq")):
        writer = df.write.mode("overwrite").option("compression", "zstd")
        with tidied(df.sparkSession):
            (writer.partitionBy("simulation_year") if partition else writer).parquet(path)
    else:
        export_csv(df, path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header; "" stays an empty quoted field, so reading back cannot turn it into null."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_result_table(df: DataFrame, path: str) -> None:
    """A report table of a few rows as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_result_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; corrupt lines are skipped, a missing file is an empty table."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as error:  # noqa: BLE001 - only a missing path is expected
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def log_tail(spark: SparkSession, path: str, n: int = 15, schema: T.StructType = ACTIVITY) -> DataFrame:
    """The newest `n` records, newest first."""
    return read_json_lines(spark, path, schema).orderBy(F.desc("ts")).limit(n)
