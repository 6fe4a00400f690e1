"""Row filters, projections, option lists and paging over the ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C


def focal(df: DataFrame, user: str | None = None, account_type: str | None = None) -> DataFrame:
    """Rows of one persona, or of every focal persona when `user` is None.

    No account type means the checking channel, "all" every account. A ledger
    without persona columns falls back to the origin account.
    """
    if not {"persona_id", "account_type"} <= set(df.columns):
        return df.where(F.col("nameOrig") == user) if user else df.where("is_focal_user")
    mine = df.where(F.col("persona_id") == user) if user else df.where(F.col("account_type") != "background")
    if account_type == "all":
        return mine
    return mine.where(F.col("account_type") == (account_type or "checking"))


def account_types(df: DataFrame, user: str | None = None) -> DataFrame:
    if "account_type" not in df.columns:
        return df.sparkSession.createDataFrame([(user, "checking")], "persona_id string, account_type string")
    mine = df.where(F.col("persona_id") == user) if user else df.where(F.col("account_type") != "background")
    return mine.where(F.col("account_type").isNotNull()).select("persona_id", "account_type").distinct()


def latest_month(whole: DataFrame) -> str | None:
    """The last month with rows. With a year column only the last year is read: first its number, then its dates."""
    if "simulation_year" in whole.columns:
        year = whole.agg(F.max("simulation_year")).first()[0]
        whole = whole.where(F.col("simulation_year") == year) if year is not None else whole
    return whole.agg(F.max(C.month_of())).first()[0]


def for_month(df: DataFrame, whole: DataFrame, month: str | None = None) -> DataFrame:
    """Rows of `month`; by default the latest month of the *whole* ledger.

    The month enters as literals: the year selects partitions where the ledger
    has them, and the range of dates reaches the scan's row-group statistics.
    """
    month = month or latest_month(whole)
    if month is None:
        return df.limit(0)
    rows = df.where(F.col("date").between(f"{month}-01", f"{month}-31"))
    return rows.where(F.col("simulation_year") == int(month[:4])) if "simulation_year" in df.columns else rows


def explore(
    df: DataFrame,
    categories: Sequence[str] | None = None,
    types: Sequence[str] | None = None,
    dates: tuple[str, str] | None = None,
    amounts: tuple[float, float] | None = None,
    accounts: Sequence[str] | None = None,
    regions: Sequence[str] | None = None,
    subcategories: Sequence[str] | None = None,
    search: str = "",
    focal_only: bool = False,
) -> DataFrame:
    """The explorer's filter: every given condition must hold; ranges are inclusive.

    `search` is a case-insensitive regular expression over merchant and origin.
    """
    lists = {
        "category": categories,
        "type": types,
        "account_type": accounts,
        "transaction_region": regions,
        "subcategory": subcategories,
    }
    for column, values in lists.items():
        if values is not None:
            df = df.where(F.col(column).isin(list(values)))
    if dates:
        df = df.where(F.col("date").between(*dates))
    if amounts:
        df = df.where(F.col("amount").between(*amounts))
    if search.strip():
        pattern = F.lit(f"(?i){search}")
        df = df.where(F.rlike(F.col("merchant"), pattern) | F.rlike(F.col("nameOrig"), pattern))
    if focal_only:
        df = df.where("is_focal_user")
    return df


def filter_options(df: DataFrame) -> DataFrame:
    """One row: the sorted distinct values of each filter column, and the ranges.

    Each domain is a small enumeration, so the sets stay small at any scale.
    """
    domains = ["category", "type", "account_type", "transaction_region", "subcategory"]
    return df.agg(
        *[F.array_join(F.sort_array(F.collect_set(c)), "|").alias(f"{c}_options") for c in domains],
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.max("amount").alias("max_amount"),
    )


def explorer_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("transactions"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"),
        C.sum_if(C.is_spending_view()).alias("spending"),
    )


def positive_amounts(df: DataFrame) -> DataFrame:
    return df.where(F.col("amount") > 0)


def page(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """One page in row order. Deep pages are cheaper with `page_after`."""
    if limit < 1 or offset < 0:
        raise ValueError("a page has at least one row and no negative offset")
    return df.orderBy("row_id").offset(offset).limit(limit)


def page_after(df: DataFrame, last_row_id: int, limit: int) -> DataFrame:
    """Keyset paging: seeks by `row_id`, so later pages cost no more than the first."""
    return df.where(F.col("row_id") > last_row_id).orderBy("row_id").limit(limit)
