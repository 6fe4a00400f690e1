"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

import calendar
import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import constants as K


def is_income(account: bool = True) -> Column:
    """Credits that count as income; `account` restricts to the checking channel."""
    mask = F.col("type").isin(K.CREDIT_TYPES)
    return mask & (F.col("account_type") == "checking") if account else mask


def is_savings_out() -> Column:
    return (F.col("type") == "TRANSFER") & (F.col("category") == "savings")


def is_expense() -> Column:
    settles = (F.col("type") == "TRANSFER") & F.col("category").isin("savings", "credit")
    return ~F.col("type").isin(K.CREDIT_TYPES) & ~settles


def is_spending_view() -> Column:
    """The explorer's wider notion of spending: everything but credits."""
    return ~F.col("type").isin(K.CREDIT_TYPES)


def sum_if(mask: Column, value: Column | str = "amount") -> Column:
    return F.coalesce(F.sum(F.when(mask, F.col(value) if isinstance(value, str) else value)), F.lit(0.0))


def rnd(value: Column | str, digits: int) -> Column:
    """Half-even rounding; NaN-free input, null stays null."""
    return F.bround(F.col(value) if isinstance(value, str) else value, digits)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def logistic(value: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-value))


def min_max(value: Column, low: Column, high: Column) -> Column:
    return (value - low) / (high - low + F.lit(1e-9))


def month_of(column: str = "date") -> Column:
    """`YYYY-MM` of an ISO string; a substring keeps the scan free of parsing."""
    return F.substring(column, 1, 7)


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))


def step_iso(step: Column, start: str) -> Column:
    """ISO minute string of an hourly step; plain calendar arithmetic, no time zone."""
    day = F.date_add(F.lit(start).cast("date"), F.floor(step / 24).cast("int"))
    return F.concat(day.cast("string"), F.lit("T"), F.lpad(F.pmod(step, F.lit(24)).cast("string"), 2, "0"), F.lit(":00"))


def step_time(step: Column, start: str) -> Column:
    """Instant of an hourly step, counted in UTC so that no clock change bends an hour."""
    seconds = calendar.timegm(datetime.date.fromisoformat(start).timetuple())
    return F.timestamp_seconds(F.lit(seconds) + step * 3600)


def utc_text(ts: Column) -> Column:
    """Wall-clock text of an instant in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970; a timestamp without zone is read as it stands."""
    if dict(df.dtypes)[ts] != "timestamp_ntz":
        return F.unix_micros(ts)
    days = F.datediff(ts, F.lit("1970-01-01")).cast("long")
    seconds = F.extract(F.lit("SECOND"), F.col(ts))
    minutes = (days * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("long")


def is_holiday(month: Column, day: Column) -> Column:
    """Mid-November to the end of December."""
    return (month == 12) | ((month == 11) & (day >= 15))


def seasonal_multiplier(category: Column, month: Column) -> Column:
    """Monthly spend multiplier from the fixed table, 1.0 where a category is flat."""
    table = F.create_map(
        *[x for name, values in K.SEASONAL.items() for x in (F.lit(name), F.array(*[F.lit(v) for v in values]))]
    )
    return F.coalesce(F.try_element_at(F.try_element_at(table, category), month), F.lit(1.0))


def is_payday(cadence: Column, day: Column, payday: Column, weekday: Column, payday_weekday: Column, day_index: Column, offset: Column) -> Column:
    """Payday by income cadence; biweekly paydays repeat every 14 days from `offset`."""
    return (
        F.when(cadence == "monthly", day == payday)
        .when(cadence == "semimonthly", (day == payday) | (day == F.least(F.lit(28), payday + 14)))
        .when(cadence == "weekly", weekday == payday_weekday)
        .otherwise(F.pmod(day_index - offset, F.lit(14)) == 0)
    )


def category_group(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.CATEGORY_GROUP.items() for x in pair])
    return F.coalesce(F.try_element_at(table, category), F.lit("other"))


def label_or_legitimate(column: str = "fraud_archetype") -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("legitimate"))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, o1, a2, o2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.lit(2 * K.EARTH_RADIUS_MILES) * F.asin(F.sqrt(h))


def regions(spark: SparkSession) -> DataFrame:
    """The fixed region dimension, 36 rows."""
    rows = [(K.region_id(i), city, state, lat, lon) for i, (city, state, lat, lon) in enumerate(K.REGIONS)]
    return spark.createDataFrame(rows, "region_id string, city string, state string, lat double, lon double")


def with_region_distance(df: DataFrame, name: str = "region_distance_miles") -> DataFrame:
    """Miles between the transaction's region and the home region, 0 for unknown regions."""
    dim = regions(df.sparkSession)
    tx = dim.select(F.col("region_id").alias("transaction_region"), F.col("lat").alias("_ta"), F.col("lon").alias("_to"))
    home = dim.select(F.col("region_id").alias("home_region"), F.col("lat").alias("_ha"), F.col("lon").alias("_ho"))
    miles = haversine_miles(F.col("_ta"), F.col("_to"), F.col("_ha"), F.col("_ho"))
    return (
        df.join(F.broadcast(tx), "transaction_region", "left")
        .join(F.broadcast(home), "home_region", "left")
        .withColumn(name, F.coalesce(miles, F.lit(0.0)))
        .drop("_ta", "_to", "_ha", "_ho")
    )
