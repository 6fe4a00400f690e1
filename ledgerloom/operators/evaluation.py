"""Metrics, curves, fairness, stability, calibration and model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators.blocks import running_totals


def ranking(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct score, highest first: its positives and negatives
    (`pos`, `neg`) and those at or above it (`tp`, `fp`).

    Ties share one row. The running totals cross group borders, so each group
    takes off what it started with; groups are models or folds, a handful.
    """
    by = list(by)
    per_score = df.groupBy(*by, score).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum((1 - F.col(y)).cast("long")).alias("neg")
    )
    out = running_totals(per_score, [*by, F.desc(score)], {"tp": "pos", "fp": "neg"})
    if by:
        start = out.groupBy(*by).agg(F.min(F.col("tp") - F.col("pos")).alias("_tp0"), F.min(F.col("fp") - F.col("neg")).alias("_fp0"))
        out = (
            out.join(F.broadcast(start), by)
            .withColumn("tp", F.col("tp") - F.col("_tp0"))
            .withColumn("fp", F.col("fp") - F.col("_fp0"))
            .drop("_tp0", "_fp0")
        )
    return out


def metrics(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 at the threshold, ROC-AUC, and average precision.

    AUC counts ties as half; average precision sums steps without
    interpolation. Groups with a single class get null for both areas.
    """
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    at = F.col(score) >= threshold
    pairs = F.col("neg").cast("double") * (F.col("tp") - F.col("pos")) + 0.5 * F.col("neg").cast("double") * F.col("pos")
    step = F.col("pos") * F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))
    raw = ranking(df, y, score, by).groupBy(*by).agg(
        C.sum_if(at, F.col("pos").cast("double")).alias("hit"),
        C.sum_if(at, (F.col("pos") + F.col("neg")).cast("double")).alias("called"),
        pos.alias("p"),
        neg.alias("n"),
        F.sum(pairs).alias("pairs"),
        F.sum(step).alias("steps"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return raw.select(
        *by,
        C.rnd(ratio(F.col("hit"), F.col("called")), 4).alias("precision"),
        C.rnd(ratio(F.col("hit"), F.col("p")), 4).alias("recall"),
        C.rnd(ratio(2 * F.col("hit"), F.col("called") + F.col("p")), 4).alias("f1"),
        C.rnd(F.try_divide(F.col("pairs"), F.col("p") * F.col("n")), 4).alias("roc_auc"),
        C.rnd(F.when(F.col("n") > 0, F.try_divide(F.col("steps"), F.col("p"))), 4).alias("pr_auc"),
    )


def confusion(df: DataFrame, y: str = "y", score: str = "score", threshold: float = 0.5) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), (F.col(score) >= threshold).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def roc_points(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    curve = ranking(df, y, score)
    totals = df.agg(F.sum(F.col(y)).cast("double").alias("p"), F.sum(1 - F.col(y)).cast("double").alias("n"))
    p, n = totals.select("p").scalar(), totals.select("n").scalar()
    return curve.select(F.col(score).alias("threshold"), "tp", "fp", F.try_divide(F.col("fp"), n).alias("fpr"), F.try_divide(F.col("tp"), p).alias("tpr"))


def pr_points(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    p = df.agg(F.sum(F.col(y)).cast("double")).scalar()
    return ranking(df, y, score).select(
        F.col(score).alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide(F.col("tp"), p).alias("recall"),
    )


def _hit(score: str, threshold: float) -> Column:
    return (F.col(score) >= threshold).cast("double")


def archetype_recall(df: DataFrame, y: str = "y", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Recall per fraud archetype over the positives; precision equals it there."""
    rows = df.where((F.col(y) == 1) & (F.col("archetype") != ""))
    recall = C.rnd(F.avg(_hit(score, threshold)), 4)
    return rows.groupBy("archetype").agg(recall.alias("recall"), recall.alias("precision"), F.count("*").alias("support"))


def cohort_recall(df: DataFrame, y: str = "y", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Recall per cohort and the ratio of the best to the worst of them."""
    rows = df.where((F.col(y) == 1) & (F.col("cohort") != ""))
    table = rows.groupBy("cohort").agg(C.rnd(F.avg(_hit(score, threshold)), 4).alias("recall"), F.count("*").alias("support"))
    top, low = (table.agg(f("recall")).scalar() for f in (F.max, F.min))
    ratio = F.when(top <= 0, F.lit(1.0)).when(low == 0, F.lit(float("inf"))).otherwise(C.rnd(F.try_divide(top, low), 3))
    return table.withColumn("disparity_ratio", ratio)


def weak_spots(archetypes: DataFrame, limit: float = 0.5) -> DataFrame:
    return archetypes.where(F.col("recall") < limit)


def position_bucket(index: Column, n: Column, buckets: int) -> Column:
    """Bucket of a row position; borders are floor(n * i / buckets)."""
    edges = [F.floor(n * F.lit(i / buckets)) for i in range(1, buckets)]
    passed = [F.when(index >= e, 1).otherwise(0) for e in edges]
    total = F.lit(0)
    for p in passed:
        total = total + p
    return total.cast("int")


def temporal_stability(df: DataFrame, y: str = "y", score: str = "score", buckets: int = 5, threshold: float = 0.5) -> DataFrame:
    """Precision and recall per equal-count time bucket. `row_id` is the dense time rank."""
    n = df.agg(F.count("*").cast("double")).scalar()
    pred = F.col(score) >= threshold
    out = df.groupBy(position_bucket(F.col("row_id"), n, buckets).alias("bucket")).agg(
        F.min("step").alias("start_step"),
        F.max("step").alias("end_step"),
        F.count_if(pred & (F.col(y) == 1)).alias("tp"),
        F.count_if(pred).alias("called"),
        F.sum(F.col(y).cast("long")).alias("support"),
    )
    return out.select(
        "bucket",
        "start_step",
        "end_step",
        C.rnd(F.col("tp") / F.greatest(F.lit(1), F.col("called")), 4).alias("precision"),
        C.rnd(F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0)), 4).alias("recall"),
        "support",
    )


def brier(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    gap = F.col(score) - F.col(y)
    return df.agg(C.rnd(F.avg(gap * gap), 4).alias("brier"))


def calibration_curve(df: DataFrame, y: str = "y", score: str = "score", bins: int = 10) -> DataFrame:
    """Mean score and observed rate per score bin.

    A bin starts at the double `i * (1 / bins)`, so 0.3 lies below the third
    edge, which is 0.30000000000000004.
    """
    passed = F.lit(0)
    for i in range(1, bins):
        passed = passed + F.when(F.col(score) >= F.lit(i * (1.0 / bins)), 1).otherwise(0)
    return df.groupBy(passed.cast("int").alias("bin")).agg(
        C.rnd(F.avg(score), 4).alias("mean_pred"),
        C.rnd(F.avg(F.col(y).cast("double")), 4).alias("frac_pos"),
        F.count("*").alias("count"),
    )


def calibration_error(curve: DataFrame) -> DataFrame:
    gap = F.abs(F.col("mean_pred") - F.col("frac_pos"))
    return curve.agg(C.rnd(F.try_divide(F.sum(F.col("count") * gap), F.sum("count")), 4).alias("ece"))


def canary_diff(old: DataFrame, new: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Recall per archetype, old against new, in percentage points.

    A key on one side only has no delta and is never a regression. The delta is
    rounded first, so a drop of exactly the tolerance stays clean.
    """
    o = old.select("archetype", F.col("recall").alias("old"), F.col("support").alias("_os"))
    n = new.select("archetype", F.col("recall").alias("new"), F.col("support").alias("_ns"))
    delta = C.rnd((F.col("new") - F.col("old")) * 100.0, 6)
    return o.join(n, "archetype", "full_outer").select(
        "archetype",
        "old",
        "new",
        delta.alias("delta_pp"),
        F.coalesce("_ns", "_os").alias("support"),
        F.coalesce(delta < -tolerance * 100.0, F.lit(False)).alias("regressed"),
    )


def canary_verdict(diff: DataFrame) -> DataFrame:
    return diff.agg(
        F.count_if("regressed").alias("regressions"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("regressed"), F.col("archetype")))), ",").alias("regressed"),
        F.when(F.count_if("regressed") > 0, "regressed").otherwise("clean").alias("verdict"),
    )


def temporal_split(df: DataFrame, test_size: float = 0.25) -> DataFrame:
    """Adds `is_train`: the first int(n * (1 - test_size)) rows in time order."""
    cut = df.agg(F.floor(F.count("*") * F.lit(1.0 - test_size))).scalar()
    return df.withColumn("is_train", F.col("row_id") < cut)


def time_series_folds(df: DataFrame, n: Column, folds: int = 5) -> DataFrame:
    """Adds `fold`: the last `folds` blocks of n // (folds + 1) rows; earlier rows are train-only (-1).

    Fold f tests on its block and trains on everything before it.
    """
    size = F.floor(n / F.lit(folds + 1))
    start = n - size * folds
    fold = F.when((F.col("row_id") < start) | (F.col("row_id") >= n), F.lit(-1)).otherwise(F.floor((F.col("row_id") - start) / size))
    return df.withColumn("fold", fold.cast("int"))


def fold_summary(fold_metrics: DataFrame, by: Sequence[str], names: Sequence[str] = ("pr_auc", "roc_auc", "f1")) -> DataFrame:
    """Mean and population deviation over folds that had both classes."""
    usable = fold_metrics.where(F.col("roc_auc").isNotNull() & F.col("pr_auc").isNotNull())
    aggs = []
    for name in names:
        aggs += [C.rnd(F.avg(name), 4).alias(f"{name}_mean"), C.rnd(F.stddev_pop(name), 4).alias(f"{name}_std")]
    return usable.groupBy(*by).agg(*aggs)


def select_model(cv: DataFrame, tolerance_std: float = 1.0, prefer_explainable: bool = True) -> DataFrame:
    """Best mean PR-AUC, or the best explainable model within the leader's deviation.

    `cv` has one row per model: model, pr_auc_mean, pr_auc_std, holdout_pr_auc, explainable.
    """
    valued = cv.withColumn("value", F.coalesce("pr_auc_mean", "holdout_pr_auc"))
    leader = valued.agg(F.max(F.struct("value", "model", F.coalesce("pr_auc_std", F.lit(0.0)).alias("std")))).scalar()
    within = leader["value"] - F.col("value") <= tolerance_std * leader["std"]
    rank = F.when(within & F.col("explainable") & F.lit(prefer_explainable), 2).when(F.col("model") == leader["model"], 1).otherwise(0)
    best = valued.withColumn("rank", rank).agg(F.max(F.struct("rank", "value", "model")).alias("b"))
    return best.select(F.col("b.model").alias("selected"), F.col("b.value").alias("pr_auc")).withColumn("leader", leader["model"])


def negatives_cap(df: DataFrame, max_rows: int, y: str = "y", seed: int = 42, buckets: int = 1 << 16) -> DataFrame:
    """Keep every positive and as many negatives as `max_rows` leaves room for.

    Positives alone beyond `max_rows` leave the negatives as they are.

    Negatives are ranked by a seeded hash. Counts per hash bucket find the
    bucket the cut falls into, and only that one bucket is ordered.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), "row_id")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    negatives = hashed.where(F.col(y) == 0)
    positives = df.where(F.col(y) == 1)
    left = F.lit(max_rows) - F.count("*")
    room = positives.agg(F.when(left > 0, left).otherwise(F.lit(1 << 62))).scalar()
    counts = negatives.groupBy("_b").agg(F.count("*").alias("n"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    # at most `buckets` rows, whatever the size of the ledger
    ends = counts.withColumn("end", F.sum("n").over(upto))
    full = ends.where(F.col("end") <= room).agg(F.coalesce(F.max("_b"), F.lit(-1)).alias("b"), F.coalesce(F.max("end"), F.lit(0)).alias("taken"))
    last, taken = full.select("b").scalar(), full.select("taken").scalar()
    edge = ends.where(F.col("end") > room).agg(F.min("_b")).scalar()
    in_edge = Window.partitionBy("_b").orderBy("_h", "row_id")
    boundary = (
        negatives.where(F.col("_b") == edge)
        .withColumn("_rn", F.row_number().over(in_edge))
        .where(F.col("_rn") <= room - taken)
    )
    whole = negatives.where(F.col("_b") <= last)
    return positives.unionByName(whole.select(*df.columns)).unionByName(boundary.select(*df.columns))
