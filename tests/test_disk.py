"""What stays on disk: stored tables that are read again, and no shuffle files of finished writes."""

import datetime
from pathlib import Path

from pyspark.sql import functions as F

from ledgerloom.operators.features import FEATURES, build_features
from ledgerloom.session import pin, shared_folder
from ledgerloom.sources import ledger as L


def files_of(spark):
    return set(Path(shared_folder(spark).removeprefix("file://")).glob("indexed-*"))


def shuffled(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {blocks.apply(i).getName() for i in range(blocks.size())}


def test_pin_leaves_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before, before = spark.conf.get(name), shuffled(spark)
    out = pin(spark.range(20_000).repartition(3, "id"), "some")
    assert not [f for f in shuffled(spark) - before if f.startswith("shuffle_")]
    assert out.count() == 20_000 and spark.conf.get(name) == set_before


def test_ingest_leaves_only_the_ledger(spark, tmp_path):
    """Rows are numbered densely, years lie in folders, and what was stored on the way is gone."""
    day = lambda i: datetime.date(1996, 1, 1) + datetime.timedelta(days=37 * i)
    lines = [(i % 5, i % 4, i % 3, i, float(i % 7 + 1), 10.0 * i, 0.1, 0.2, "N", "O", day(i % 40)) for i in range(200)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    spark.createDataFrame(lines, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i + 1) for i in range(5)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, i + 2) for i in range(4)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(60).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    before = files_of(spark)
    rows = L.ledger(spark, str(tmp_path))
    assert files_of(spark) == before
    assert [r["row_id"] for r in rows.select("row_id").orderBy("row_id").collect()] == list(range(200))
    assert rows.where(F.col("simulation_year") != F.year(F.to_date("date"))).count() == 0
    assert [r["step"] for r in rows.orderBy("row_id").collect()] == sorted(r["step"] for r in rows.collect())
    plain, staged = (build_features(rows, staged=s).orderBy("row_id").select(*FEATURES).collect() for s in (False, True))
    assert plain == staged
