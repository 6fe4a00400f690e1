"""The stored feature table: built once per application, then scanned by models and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.features import FEATURES, history_features, value_features
from ledgerloom.session import pin, unpin
from ledgerloom.sources.ledger import ledger

_STORED: dict[tuple[str, str], DataFrame] = {}


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`row_id`, the 32 features, and the label columns models are trained and judged by."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        rows = ledger(spark, sf_dir)
        labels = rows.select("row_id", F.col("isFraud").alias("y"), F.col("fraud_archetype").alias("archetype"))
        # the labels join the few columns of the history; what follows from a row alone is added after that shuffle
        found = history_features(rows, staged=True)
        whole = found.join(labels, "row_id").withColumns(value_features())
        _STORED[key] = pin(whole.select("row_id", "step", "y", "archetype", *FEATURES), "features")
        unpin(found)
    return _STORED[key].select("row_id", "step", "y", "archetype", *FEATURES)


_VECTORS: dict[tuple[str, str], DataFrame] = {}


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`id` and unit vector of every row: expressions over the stored features, with the statistics fitted once.

    32 floats a row would take more disk than the features they follow from.
    """
    from ledgerloom.operators.retrieval import ledger_embeddings

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VECTORS:
        _VECTORS[key] = ledger_embeddings(stored_features(spark, sf_dir), FEATURES)
    return _VECTORS[key]
