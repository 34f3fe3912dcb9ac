"""Time expressions on naive timestamps.

``date_trunc`` turns ``timestamp_ntz`` into a zoned timestamp and shifts inside daylight-saving gaps, so
hours are floored with the tumbling ``window`` expression and months with date functions.
"""

from __future__ import annotations

import math
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def naive(value: datetime | date | str) -> Column:
    """A ``timestamp_ntz`` literal from a datetime, a date or an ISO text."""
    text = value if isinstance(value, str) else value.isoformat()
    return F.lit(text).cast("timestamp_ntz")


def floor_hour(ts: Column | str) -> Column:
    return F.window(ts, "1 hour")["start"]


def first_hour_of_month(ts: Column | str) -> Column:
    return F.trunc(ts, "MM").cast("timestamp_ntz")


def last_hour_of_month(ts: Column | str) -> Column:
    return F.last_day(ts).cast("timestamp_ntz") + F.expr("interval 23 hours")


def next_month_start(ts: Column | str) -> Column:
    return F.add_months(F.trunc(ts, "MM"), 1).cast("timestamp_ntz")


def month_label(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def hour_steps(first: Column, last: Column) -> Column:
    """Every hour from ``first`` to ``last``, both included, as an array."""
    return F.sequence(first, last, F.expr("interval 1 hour"))


def hour_calendar(spark: SparkSession, first: datetime, last: datetime, name: str = "timestamp") -> DataFrame:
    """Every hour of a closed range, one row each; days are generated in parallel, hours within them."""
    days = (last.date() - first.date()).days + 1
    midnight = naive(first.date())
    hours = spark.range(days).select(
        F.explode(F.sequence(F.lit(0), F.lit(23))).alias("_hour"), F.col("id").cast("int").alias("_day")
    )
    stamp = midnight + F.make_dt_interval(F.col("_day"), F.col("_hour"))
    return hours.select(stamp.alias(name)).where(F.col(name).between(naive(first), naive(last)))


def add_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hour, Monday-based weekday, month and weekend flag."""
    weekday = F.weekday(ts)
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": weekday,
            "month": F.month(ts),
            "is_weekend": (weekday >= 5).cast("tinyint"),
        }
    )


def add_cyclic(df: DataFrame, column: str, period: int) -> DataFrame:
    """Sine and cosine of a cyclic column, so that its last value is next to its first."""
    angle = F.col(column) * F.lit(2 * math.pi) / F.lit(period)
    return df.withColumns({f"{column}_sin": F.sin(angle), f"{column}_cos": F.cos(angle)})
