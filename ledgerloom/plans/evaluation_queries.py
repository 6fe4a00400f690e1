"""Evaluation tables over the labelled scores of the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import evaluation as E
from ledgerloom.plans.registry import query
from ledgerloom.plans.sqlkit import over_ledger, rnd
from ledgerloom.sources.ledger import labeled_scores


def _models(spark, sf):
    """One row per transaction and model."""
    scores = labeled_scores(spark, sf)
    pairs = F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("s")) for c in ("score", "score_alt")])
    return scores.withColumn("m", F.explode(pairs)).select("row_id", "step", "y", "archetype", "cohort", "m.model", F.col("m.s").alias("score"))


MODELS_SQL = "models AS (SELECT row_id, step, y, archetype, cohort, 'score' AS model, score FROM scores UNION ALL SELECT row_id, step, y, archetype, cohort, 'score_alt', score_alt FROM scores)"


def _metrics_sql(source: str, by: str) -> str:
    return f"""curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM
  (SELECT {by}, score, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) - sum(y) AS DOUBLE) AS neg FROM {source} GROUP BY {by}, score)
  WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)),
metrics AS (SELECT {by}, {rnd('coalesce(hit / nullif(called, 0), 0)', 4)} AS precision, {rnd('coalesce(hit / nullif(p, 0), 0)', 4)} AS recall,
  {rnd('coalesce(2 * hit / nullif(called + p, 0), 0)', 4)} AS f1, {rnd('area / nullif(p * n, 0)', 4)} AS roc_auc,
  {rnd('CASE WHEN n > 0 THEN ap / nullif(p, 0) END', 4)} AS pr_auc FROM
  (SELECT {by}, coalesce(sum(pos) FILTER (score >= 0.5), 0) AS hit, coalesce(sum(pos + neg) FILTER (score >= 0.5), 0) AS called, sum(pos) AS p, sum(neg) AS n,
    sum(neg * (tp - pos) + 0.5::DOUBLE * neg * pos) AS area, sum(pos * tp / (tp + fp)) AS ap FROM curve GROUP BY {by}))"""


@query("metrics_by_model", over_ledger("SELECT * FROM metrics", MODELS_SQL, _metrics_sql("models", "model")))
def _(spark, sf):
    return E.metrics(_models(spark, sf), by=["model"])


@query("confusion_matrix", over_ledger("SELECT y, CAST(score >= 0.5 AS INTEGER) AS predicted, count(*) AS n FROM scores GROUP BY 1, 2"))
def _(spark, sf):
    return E.confusion(labeled_scores(spark, sf))


CURVE_SQL = "pts AS (SELECT score, sum(sum(y)) OVER w AS tp, sum(count(*) - sum(y)) OVER w AS fp FROM scores GROUP BY score WINDOW w AS (ORDER BY score DESC))"


@query("cumulative_counts", over_ledger("SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM pts", CURVE_SQL))
def _(spark, sf):
    return E.ranking(labeled_scores(spark, sf)).select("score", "tp", "fp")


@query(
    "roc_points",
    over_ledger(
        f"SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {rnd('fp / (SELECT count(*) - sum(y) FROM scores)::DOUBLE', 6)} AS fpr, {rnd('tp / (SELECT sum(y) FROM scores)::DOUBLE', 6)} AS tpr FROM pts",
        CURVE_SQL,
    ),
)
def _(spark, sf):
    return E.roc_points(labeled_scores(spark, sf)).select("threshold", "tp", "fp", F.bround("fpr", 6).alias("fpr"), F.bround("tpr", 6).alias("tpr"))


@query(
    "precision_recall_points",
    over_ledger(f"SELECT score AS threshold, {rnd('tp / (tp + fp)', 6)} AS precision, {rnd('tp / (SELECT sum(y) FROM scores)::DOUBLE', 6)} AS recall FROM pts", CURVE_SQL),
)
def _(spark, sf):
    return E.pr_points(labeled_scores(spark, sf)).select("threshold", F.bround("precision", 6).alias("precision"), F.bround("recall", 6).alias("recall"))


def _recall_sql(score: str, name: str) -> str:
    return f"{name} AS (SELECT archetype, {rnd(f'avg(CAST({score} >= 0.5 AS DOUBLE))', 4)} AS recall, count(*) AS support FROM scores WHERE y = 1 AND archetype <> '' GROUP BY 1)"


@query("archetype_recall", over_ledger("SELECT archetype, recall, recall AS precision, support FROM r", _recall_sql("score", "r")))
def _(spark, sf):
    return E.archetype_recall(labeled_scores(spark, sf))


@query("weak_archetypes", over_ledger("SELECT archetype, recall, recall AS precision, support FROM r WHERE recall < 0.5", _recall_sql("score", "r")))
def _(spark, sf):
    return E.weak_spots(E.archetype_recall(labeled_scores(spark, sf)))


COHORT_SQL = f"c AS (SELECT cohort, {rnd('avg(CAST(score >= 0.5 AS DOUBLE))', 4)} AS recall, count(*) AS support FROM scores WHERE y = 1 AND cohort <> '' GROUP BY 1)"
RATIO_SQL = f"CASE WHEN max(recall) OVER () <= 0 THEN 1.0 WHEN min(recall) OVER () = 0 THEN 'inf'::DOUBLE ELSE {rnd('max(recall) OVER () / nullif(min(recall) OVER (), 0)', 3)} END"


@query("cohort_recall", over_ledger(f"SELECT cohort, recall, support, {RATIO_SQL} AS disparity_ratio FROM c", COHORT_SQL))
def _(spark, sf):
    return E.cohort_recall(labeled_scores(spark, sf))


@query("worst_disparity", over_ledger(f"SELECT max(r) AS disparity FROM (SELECT {RATIO_SQL} AS r FROM c)", COHORT_SQL))
def _(spark, sf):
    return E.cohort_recall(labeled_scores(spark, sf)).agg(F.max("disparity_ratio").alias("disparity"))


def _bucket_sql(k: int) -> str:
    return " + ".join(f"CAST(row_id >= floor(n * {i / k!r}::DOUBLE) AS INTEGER)" for i in range(1, k))


@query(
    "temporal_stability",
    over_ledger(
        f"""SELECT bucket, min(step) AS start_step, max(step) AS end_step,
        {rnd('count(*) FILTER (score >= 0.5 AND y = 1) / greatest(1, count(*) FILTER (score >= 0.5))', 4)} AS precision,
        {rnd('coalesce(count(*) FILTER (score >= 0.5 AND y = 1) / nullif(sum(y), 0), 0)', 4)} AS recall, CAST(sum(y) AS BIGINT) AS support
        FROM (SELECT *, {_bucket_sql(7)} AS bucket FROM scores, (SELECT count(*) AS n FROM scores)) GROUP BY 1""".replace("count(*) FILTER (score >= 0.5 AND y = 1) /", "CAST(count(*) FILTER (score >= 0.5 AND y = 1) AS DOUBLE) /"),
    ),
)
def _(spark, sf):
    return E.temporal_stability(labeled_scores(spark, sf), buckets=7)


@query("brier_score", over_ledger(f"SELECT {rnd('avg((score - y) * (score - y))', 4)} AS brier FROM scores"))
def _(spark, sf):
    return E.brier(labeled_scores(spark, sf))


EDGES = " + ".join(f"CAST(score >= CAST('{i * 0.1!r}' AS DOUBLE) AS INTEGER)" for i in range(1, 10))
BINS_SQL = f"bins AS (SELECT {EDGES} AS bin, {rnd('avg(score)', 4)} AS mean_pred, {rnd('avg(CAST(y AS DOUBLE))', 4)} AS frac_pos, count(*) AS count FROM scores GROUP BY 1)"


@query("calibration_curve", over_ledger("SELECT * FROM bins", BINS_SQL))
def _(spark, sf):
    return E.calibration_curve(labeled_scores(spark, sf))


@query("calibration_error", over_ledger(f"SELECT {rnd('sum(count * abs(mean_pred - frac_pos)) / sum(count)', 4)} AS ece FROM bins", BINS_SQL))
def _(spark, sf):
    return E.calibration_error(E.calibration_curve(labeled_scores(spark, sf)))


DIFF_SQL = f"""diff AS (SELECT archetype, o.recall AS old, n.recall AS new, {rnd('(n.recall - o.recall) * 100.0::DOUBLE', 6)} AS delta_pp, coalesce(n.support, o.support) AS support,
  coalesce({rnd('(n.recall - o.recall) * 100.0::DOUBLE', 6)} < -5.0, false) AS regressed
  FROM (SELECT * FROM a WHERE archetype <> 'mimicry') o FULL JOIN (SELECT * FROM b WHERE archetype <> 'bust_out') n USING (archetype))"""


def _diff(spark, sf):
    scores = labeled_scores(spark, sf)
    old = E.archetype_recall(scores).where(F.col("archetype") != "mimicry")
    new = E.archetype_recall(scores, score="score_alt").where(F.col("archetype") != "bust_out")
    return E.canary_diff(old, new, 0.05)


@query("canary_diff", over_ledger("SELECT * FROM diff", _recall_sql("score", "a"), _recall_sql("score_alt", "b"), DIFF_SQL))
def _(spark, sf):
    return _diff(spark, sf)


@query(
    "canary_verdict",
    over_ledger(
        "SELECT count(*) FILTER (regressed) AS regressions, coalesce(string_agg(archetype, ',' ORDER BY archetype) FILTER (regressed), '') AS regressed, CASE WHEN count(*) FILTER (regressed) > 0 THEN 'regressed' ELSE 'clean' END AS verdict FROM diff",
        _recall_sql("score", "a"), _recall_sql("score_alt", "b"), DIFF_SQL,
    ),
)
def _(spark, sf):
    return E.canary_verdict(_diff(spark, sf))


@query(
    "temporal_split",
    over_ledger(
        "SELECT row_id < floor(n * 0.75::DOUBLE) AS is_train, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS fraud, min(step) AS first_step, max(step) AS last_step FROM scores, (SELECT count(*) AS n FROM scores) GROUP BY 1"
    ),
)
def _(spark, sf):
    return E.temporal_split(labeled_scores(spark, sf)).groupBy("is_train").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("y").cast("long")).alias("fraud"), F.min("step").alias("first_step"), F.max("step").alias("last_step")
    )


@query(
    "negatives_cap",
    over_ledger("SELECT y, CASE y WHEN 1 THEN count(*) ELSE least(count(*), 20000 - (SELECT sum(y) FROM scores)) END AS n FROM scores GROUP BY 1"),
)
def _(spark, sf):
    return E.negatives_cap(labeled_scores(spark, sf), 20_000).groupBy("y").agg(F.count("*").alias("n"))


FOLDS_SQL = """folded AS (SELECT *, CASE WHEN row_id < n - 5 * (n // 6) THEN -1 ELSE (row_id - (n - 5 * (n // 6))) // (n // 6) END AS fold
  FROM models, (SELECT count(*) AS n FROM scores))"""


def _folded(spark, sf):
    n = labeled_scores(spark, sf).agg(F.count("*")).scalar()
    return E.time_series_folds(_models(spark, sf), n)


@query(
    "time_series_folds",
    over_ledger("SELECT CAST(fold AS INTEGER) AS fold, count(*) // 2 AS n_rows, min(step) AS first_step, max(step) AS last_step FROM folded GROUP BY 1", MODELS_SQL, FOLDS_SQL),
)
def _(spark, sf):
    n = labeled_scores(spark, sf).agg(F.count("*")).scalar()
    return E.time_series_folds(labeled_scores(spark, sf), n).groupBy("fold").agg(
        F.count("*").alias("n_rows"), F.min("step").alias("first_step"), F.max("step").alias("last_step")
    )


FOLD_METRICS_SQL = "tested AS (SELECT CAST(fold AS INTEGER) AS fold, model, y, score FROM folded WHERE fold >= 0), " + _metrics_sql("tested", "model, fold")


def _fold_metrics(spark, sf):
    return E.metrics(_folded(spark, sf).where(F.col("fold") >= 0), by=["model", "fold"])


@query("fold_metrics", over_ledger("SELECT * FROM metrics", MODELS_SQL, FOLDS_SQL, FOLD_METRICS_SQL))
def _(spark, sf):
    return _fold_metrics(spark, sf)


CV_SQL = f"""cv AS (SELECT model, {rnd('avg(pr_auc)', 4)} AS pr_auc_mean, {rnd('stddev_pop(pr_auc)', 4)} AS pr_auc_std, {rnd('avg(roc_auc)', 4)} AS roc_auc_mean,
  {rnd('stddev_pop(roc_auc)', 4)} AS roc_auc_std, {rnd('avg(f1)', 4)} AS f1_mean, {rnd('stddev_pop(f1)', 4)} AS f1_std FROM metrics
  WHERE roc_auc IS NOT NULL AND pr_auc IS NOT NULL GROUP BY 1)"""


@query("cross_validation_summary", over_ledger("SELECT * FROM cv", MODELS_SQL, FOLDS_SQL, FOLD_METRICS_SQL, CV_SQL))
def _(spark, sf):
    return E.fold_summary(_fold_metrics(spark, sf), ["model"])


@query(
    "model_selection",
    over_ledger(
        """SELECT (SELECT model FROM cv, lead l WHERE l.v - pr_auc_mean <= l.sd ORDER BY (model = 'score_alt') DESC, (model = l.leader) DESC LIMIT 1) AS selected,
        (SELECT pr_auc_mean FROM cv, lead l WHERE l.v - pr_auc_mean <= l.sd ORDER BY (model = 'score_alt') DESC, (model = l.leader) DESC LIMIT 1) AS pr_auc, (SELECT leader FROM lead) AS leader""",
        MODELS_SQL, FOLDS_SQL, FOLD_METRICS_SQL, CV_SQL,
        "lead AS (SELECT model AS leader, pr_auc_mean AS v, pr_auc_std AS sd FROM cv ORDER BY pr_auc_mean DESC, model DESC LIMIT 1)",
    ),
)
def _(spark, sf):
    cv = E.fold_summary(_fold_metrics(spark, sf), ["model"])
    return E.select_model(cv.withColumn("holdout_pr_auc", F.lit(0.0)).withColumn("explainable", F.col("model") == "score_alt"))
