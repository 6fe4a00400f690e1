"""The canonical ledger, and its derivation from the driver's order tables.

A ledger row is one transaction. `row_id` is its rank in (step, source order)
and is assigned once, at ingest; every ordered operator uses (step, row_id).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import constants as K
from ledgerloom.functions import columns as C
from ledgerloom.operators.blocks import global_index
from ledgerloom.session import shared_folder, tidied, unpin
from ledgerloom.sources.tables import table

START = "1995-01-01"

LEDGER = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in [
            ("row_id", T.LongType()),
            ("step", T.LongType()),
            ("type", T.StringType()),
            ("amount", T.DoubleType()),
            ("nameOrig", T.StringType()),
            ("oldbalanceOrg", T.DoubleType()),
            ("newbalanceOrig", T.DoubleType()),
            ("nameDest", T.StringType()),
            ("oldbalanceDest", T.DoubleType()),
            ("newbalanceDest", T.DoubleType()),
            ("merchant", T.StringType()),
            ("category", T.StringType()),
            ("datetime", T.StringType()),
            ("date", T.StringType()),
            ("is_focal_user", T.BooleanType()),
            ("isFraud", T.IntegerType()),
            ("isFlaggedFraud", T.IntegerType()),
            ("is_anomaly", T.IntegerType()),
            ("anomaly_type", T.StringType()),
            ("persona_id", T.StringType()),
            ("persona_archetype", T.StringType()),
            ("account_type", T.StringType()),
            ("merchant_region", T.StringType()),
            ("transaction_region", T.StringType()),
            ("home_region", T.StringType()),
            ("category_group", T.StringType()),
            ("subcategory", T.StringType()),
            ("fraud_archetype", T.StringType()),
            ("label_reported_at_step", T.LongType()),
            ("simulation_year", T.IntegerType()),
        ]
    ]
)
LEDGER_COLUMNS = LEDGER.fieldNames()
# score columns of the derived ledger, used by the evaluation queries
SCORES = ["score", "score_alt"]

LINE_ORDER = [
    "step",
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]

# what a line's transaction follows from
LINE_INPUTS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"]

_KNOWN: dict[tuple[str, str], str] = {}


def _pick(values: list[str], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


def with_derived(df: DataFrame, start: str = START) -> DataFrame:
    """Columns that follow from `step`, `category` and `amount` alone."""
    return (
        df.withColumn("datetime", C.step_iso(F.col("step"), start))
        .withColumn("date", F.substring("datetime", 1, 10))
        .withColumn("category_group", C.category_group(F.col("category")))
        .withColumn("isFlaggedFraud", (F.col("amount") > 200_000).cast("int"))
        .withColumn("simulation_year", F.substring("date", 1, 4).cast("int"))
    )


def _lines(line: DataFrame) -> DataFrame:
    """What follows from an order line alone."""
    order, prt, sup, num = (F.col(f"l_{c}") for c in ("orderkey", "partkey", "suppkey", "linenumber"))
    kind, amount = F.col("type"), F.col("amount")
    return (
        line.withColumn("step", (F.datediff("l_shipdate", F.lit(START)) * 24 + (prt * 7 + num * 5 + sup) % 24).cast("long"))
        .withColumn("type", _pick(K.TYPES, (prt + num) % 8))
        .withColumn("amount", F.col("l_quantity") * 40.0)
        .withColumn("merchant", F.concat(F.lit("M"), sup.cast("string")))
        .withColumn("oldbalanceOrg", amount * (1 + order % 5).cast("double"))
        .withColumn(
            "newbalanceOrig",
            F.when(kind.isin(K.CREDIT_TYPES), F.col("oldbalanceOrg") + amount).otherwise(F.col("oldbalanceOrg") - amount),
        )
        .withColumn("oldbalanceDest", F.when(kind == "TRANSFER", F.col("l_quantity") * (sup % 7).cast("double") * 10.0).otherwise(0.0))
        .withColumn("newbalanceDest", F.when(kind == "TRANSFER", F.col("oldbalanceDest") + amount).otherwise(0.0))
        .withColumn("isFraud", ((order * 31 + num) % 97 == 0).cast("int"))
        .withColumn("is_anomaly", ((order * 13 + num * 7) % 89 == 0).cast("int"))
        .withColumn("score", ((prt * 17 + order * 3) % 1000) / 1000.0)
        .withColumn("score_alt", ((prt * 7 + order * 11) % 1000) / 1000.0)
    )


def _named(lines: DataFrame, accounts: Column) -> DataFrame:
    """Accounts, personas, places, categories and labels of each line with its order's customer and its part's size."""
    order, prt, sup = (F.col(f"l_{c}") for c in ("orderkey", "partkey", "suppkey"))
    kind = F.col("type")
    ids = [K.region_id(i) for i in range(36)]
    channel = (prt + sup) % 8
    focal = F.col("_k") % 5 == 0
    subs = F.create_map(*[x for c, v in K.SUBCATEGORIES.items() for x in (F.lit(c), F.array(*[F.lit(s) for s in v]))])
    return (
        lines.withColumn("_n", accounts)
        .withColumn("_k", F.col("o_custkey") % F.col("_n"))
        .withColumn("persona_id", F.concat(F.lit("U"), F.col("_k").cast("string")))
        .withColumn(
            "account_type",
            F.when(~focal, "background").when(channel == 0, "savings").when(channel == 1, "credit").otherwise("checking"),
        )
        .withColumn(
            "nameOrig",
            F.concat(
                "persona_id",
                F.when(focal & (channel == 0), "_Sav").when(focal & (channel == 1), "_Cred").otherwise(""),
            ),
        )
        .withColumn(
            "nameDest",
            F.when(kind == "TRANSFER", F.concat(F.lit("U"), ((sup * 13 + prt) % F.col("_n")).cast("string"))).otherwise(F.col("merchant")),
        )
        .withColumn(
            "category",
            F.when(kind == "SALARY", "income")
            .when(kind == "CASH_IN", F.when(prt % 3 == 0, "refund").otherwise("income"))
            .when(kind == "CASH_OUT", "transfer")
            .when(kind == "SUBSCRIPTION", "subscriptions")
            .when(kind == "TRANSFER", _pick(["savings", "credit", "transfer", "housing"], prt % 4))
            .otherwise(_pick(K.SPENDING_CATEGORIES[:7], F.col("p_size") % 7)),
        )
        .withColumn("is_focal_user", focal & ~channel.isin(0, 1))
        .withColumn(
            "anomaly_type",
            F.when(F.col("is_anomaly") == 1, F.when(prt % 2 == 0, "duplicate_charge").otherwise("spend_spike")).otherwise(""),
        )
        .withColumn("persona_archetype", F.when(focal, _pick(K.PERSONA_ARCHETYPES, F.col("_k") % 6)).otherwise("background"))
        .withColumn("home_region", _pick(ids, F.col("_k") % 36))
        .withColumn(
            "transaction_region",
            F.when(prt % 97 == 0, "R99_unknown")
            .when((prt * 3 + sup) % 10 == 0, _pick(ids, (F.col("_k") + 1 + prt % 35) % 36))
            .otherwise(F.col("home_region")),
        )
        .withColumn("merchant_region", F.col("transaction_region"))
        .withColumn("_subs", F.element_at(subs, F.col("category")))
        .withColumn("subcategory", F.element_at("_subs", (1 + sup % F.size("_subs")).cast("int")))
        .withColumn(
            "fraud_archetype",
            F.when(F.col("isFraud") == 1, _pick(K.FRAUD_ARCHETYPES, (order + prt) % 12))
            .when(((order * 7 + prt) % 211 == 0) & (F.col("is_anomaly") == 0), _pick(K.HARD_NEGATIVES, prt % 3))
            .otherwise(""),
        )
        .withColumn(
            "label_reported_at_step",
            F.col("step") + F.when((F.col("isFraud") == 1) & (prt % 10 == 0), 24 + order % 696).otherwise(F.lit(0)),
        )
    )


def ingest(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Number the lines in (step, source) order, map them to transactions, write the table once.

    Lines are numbered before anything is joined, so the range sample and the
    ordered shuffle see narrow rows. Accounts scale with the customer table
    (30 customers share one): rows per account stay level as the data grows.
    """
    lines = _lines(table(spark, sf_dir, "lineitem"))
    carried = [c for c in LEDGER_COLUMNS + SCORES if c in lines.columns]
    indexed = global_index(lines.select(*LINE_ORDER), LINE_ORDER, keep=LINE_INPUTS)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    accounts = table(spark, sf_dir, "customer").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 30))).scalar()
    # ranges of rows inside one year: few files per year, and rows in order inside each, so dates and ids skip row groups;
    # what follows from a line, its order and its part is added after the last shuffle, so only these inputs are on disk more than once
    year = with_derived(_lines(indexed).withColumn("category", F.lit(""))).select("row_id", *LINE_INPUTS, F.col("simulation_year").alias("_year"))
    met = year.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    met = met.select("row_id", *LINE_INPUTS, "o_custkey", "p_size", "_year").repartitionByRange("_year", "row_id").sortWithinPartitions("_year", "row_id")
    named = _named(_lines(met).select("row_id", "l_orderkey", "l_partkey", "l_suppkey", "o_custkey", "p_size", "_year", *carried), accounts)
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER.fields if f.name != "simulation_year"]
    ordered = with_derived(named).select(*typed, *SCORES, F.col("_year").alias("simulation_year"))  # sorted as it is laid out
    with tidied(spark):
        ordered.write.mode("overwrite").option("compression", "zstd").partitionBy("simulation_year").parquet(path)
    unpin(indexed)


def ledger_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the stored ledger; the first call in an application ingests it."""
    app = spark.sparkContext.applicationId
    if (app, sf_dir) not in _KNOWN:
        name = hashlib.sha1(sf_dir.encode()).hexdigest()[:12]
        path = f"{shared_folder(spark)}/ledger-{name}"
        ingest(spark, sf_dir, path)
        _KNOWN[(app, sf_dir)] = path
    return _KNOWN[(app, sf_dir)]


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([*LEDGER.fields, *[T.StructField(s, T.DoubleType()) for s in SCORES]])
    return spark.read.schema(schema).parquet(ledger_path(spark, sf_dir))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger over `sf_dir`, ingested once per application and then scanned."""
    return _stored(spark, sf_dir).select(*LEDGER_COLUMNS)


def labeled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and two model scores per transaction, for the evaluation tables."""
    return _stored(spark, sf_dir).select(
        "row_id",
        "step",
        F.col("isFraud").alias("y"),
        "score",
        "score_alt",
        F.col("fraud_archetype").alias("archetype"),
        F.col("persona_archetype").alias("cohort"),
    )
