"""The monthly report and weekly digest as one long table of sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHAPE = ["section", "position", "label", "value"]


def section(df: DataFrame, name: str, label: Column, value: Column, order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """One section: labels and values in report order. Sections are short tables."""
    ordered = df.orderBy(*order).limit(limit) if limit else df
    position = F.row_number().over(Window.orderBy(*order))
    return ordered.select(F.lit(name).alias("section"), position.alias("position"), label.alias("label"), value.cast("double").alias("value"))


def figures(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """A one-row frame as a section with one line per column."""
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("label"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns, 1)])
    return df.select(F.lit(name).alias("section"), F.inline(pairs)).select(*SHAPE)


def combine(sections: Sequence[DataFrame]) -> DataFrame:
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out


def run_record(metrics: DataFrame, profile: DataFrame, archetypes: DataFrame, cohorts: DataFrame) -> DataFrame:
    """One nested row describing a run: metrics, dataset, and the per-group tables as arrays."""
    as_array = lambda d: d.agg(F.sort_array(F.collect_list(F.struct(*d.columns)))).scalar()
    as_struct = lambda d: d.select(F.struct(*d.columns)).scalar()
    return metrics.select(
        F.struct(*metrics.columns).alias("holdout"),
        as_struct(profile).alias("dataset"),
        as_array(archetypes).alias("archetype_recall"),
        as_array(cohorts).alias("cohort_fairness"),
    )
