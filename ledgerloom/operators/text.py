"""Questions as tables: routing, mentions, carried context, number grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import constants as K

# fixed values: patterns
MONTH_PATTERN = r"\d{4}-\d{2}"
NAMED_ID = r"(?:^|[^\p{L}\p{N}_])(?:transaction|txn|id)\s+([0-9]{1,18})(?:$|[^\p{L}\p{N}_])"
BARE_ID = r"(?:^|[^\p{L}\p{N}_])([0-9]{1,18})(?:$|[^\p{L}\p{N}_])"
AMOUNT_PATTERN = r"(-?\$[0-9,]+(?:\.[0-9]+)?)"
PERCENT_PATTERN = r"(-?[0-9]+(?:\.[0-9]+)?)%"
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]


def route(text: Column) -> Column:
    """Route with the longest matched keywords in total; the first listed wins a tie."""
    q = F.lower(text)
    scored = []
    for position, (name, words) in enumerate(K.ROUTES):
        score = F.lit(0)
        for w in words:
            score = score + F.when(q.contains(w), len(w)).otherwise(0)
        scored.append(F.struct(score.alias("score"), F.lit(-position).alias("rank"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] > 0, best["name"]).otherwise("summary")


def with_route(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("route", route(F.col(text)))


def month_mention(text: Column, months: Column) -> Column:
    """Month a question names, out of the sorted array `months` that have data.

    An ISO month first, then "last month" (the one before the latest), then a
    month name, read as its latest occurrence.
    """
    q = F.lower(text)
    iso = F.regexp_extract(q, MONTH_PATTERN, 0)
    n = F.size(months)
    before_last = F.when(n >= 2, F.try_element_at(months, F.lit(-2))).otherwise(F.try_element_at(months, F.lit(-1)))
    latest = lambda number: F.array_max(F.filter(months, lambda m: F.substring(m, 6, 2) == number))
    named = F.coalesce(*[F.when(q.contains(name), latest(f"{i:02d}")) for i, name in enumerate(MONTH_NAMES, start=1)])
    return (
        F.when(F.array_contains(months, iso), iso)
        .when(q.contains("last month"), before_last)
        .otherwise(named)
    )


def transaction_mention(text: Column) -> Column:
    q = F.lower(text)
    named = F.nullif(F.regexp_extract(q, NAMED_ID, 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(q, BARE_ID, 1), F.lit(""))
    return F.coalesce(named, bare).cast("long")


def category_mention(text: Column) -> Column:
    """The last listed spending category that occurs in the text."""
    q = F.lower(text)
    return F.coalesce(*[F.when(q.contains(c), F.lit(c)) for c in reversed(K.SPENDING_CATEGORIES)])


def carry_forward(df: DataFrame, key: str, order: str, columns: list[str], block_rows: int = 100_000) -> DataFrame:
    """Last non-null value so far per key, for each column, as `<column>_context`.

    `order` counts inside the key, so blocks of it bound every window; blocks
    pass their last value on through one row per (key, block).
    """
    rows = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block_rows)))
    upto = Window.partitionBy(key, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where(F.col("_blk") > 0).select(key).distinct()
    last = (
        rows.join(ends, key, "left_semi")
        .groupBy(key, "_blk")
        .agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_l_{c}") for c in columns])
        .select(key, "_blk", *[F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_p_{c}") for c in columns])
    )
    out = rows
    for c in columns:
        out = out.withColumn(f"_i_{c}", F.last(c, ignorenulls=True).over(upto))
    out = out.join(last, [key, "_blk"], "left")
    for c in columns:
        out = out.withColumn(f"{c}_context", F.coalesce(f"_i_{c}", f"_p_{c}"))
    return out.drop("_blk", *[f"_i_{c}" for c in columns], *[f"_p_{c}" for c in columns])


def figures(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Every dollar amount and percentage a text states: (keys, kind, value)."""
    amounts = F.transform(
        F.regexp_extract_all(F.col(text), F.lit(AMOUNT_PATTERN), F.lit(1)),
        lambda m: F.struct(F.lit("amount").alias("kind"), F.regexp_replace(m, "[$,]", "").try_cast("double").alias("value")),
    )
    percents = F.transform(
        F.regexp_extract_all(F.col(text), F.lit(PERCENT_PATTERN), F.lit(1)),
        lambda m: F.struct(F.lit("percent").alias("kind"), m.try_cast("double").alias("value")),
    )
    return df.select(*keys, F.inline(F.concat(amounts, percents)))


def ungrounded(claims: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Claimed figures that no fact of the same key carries, to two decimals."""
    rounded = lambda d: d.withColumn("value", F.bround("value", 2))
    return rounded(claims).join(rounded(facts).select(*keys, "kind", "value").distinct(), [*keys, "kind", "value"], "left_anti")
