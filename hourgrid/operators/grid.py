"""The complete hour x station grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.time import first_hour_of_month, hour_steps, last_hour_of_month


def grid_bounds(hourly: DataFrame, ts: str = "timestamp") -> DataFrame:
    """First hour of the first month and last hour of the last month in the data, in one row."""
    return hourly.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).select(
        first_hour_of_month("lo").alias("first_hour"), last_hour_of_month("hi").alias("last_hour")
    )


def complete_months(members: DataFrame, key: str, bounds: DataFrame) -> DataFrame:
    """Every member with the first hour of every month of ``bounds`` as ``_month``.

    The bounds reach the members as scalar subqueries and each member row unfolds its own months: no
    cross join. The few rows would sit in one partition and unfold their hours in one task, so they are
    spread first; a fixed number of partitions is not coalesced again.
    """
    first = bounds.select("first_hour").scalar()
    last = bounds.select("last_hour").scalar()
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    months = members.select(key, F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("_month"))
    return months.repartition(tasks, key, "_month")


def dense_grid(hourly: DataFrame, members: DataFrame, key: str, value: str, ts: str = "timestamp") -> DataFrame:
    """Total ``value`` for every member and hour, zero where nothing was counted.

    ``hourly`` has the members' rows and no others. Bounds come from those rows over all months, so a
    station that stops is zero-filled to the end. A member meets what it counted in a month, at most one
    value for each hour, and unfolds the hours after that: only counted hours are shuffled, never the grid.
    """
    skeleton = complete_months(members, key, grid_bounds(hourly, ts))
    totals = hourly.where(F.col(ts).isNotNull()).groupBy(ts, key).agg(F.sum(value).alias(value))
    counted = F.map_from_entries(F.collect_list(F.struct(ts, value))).alias("_counted")
    by_month = totals.groupBy(key, first_hour_of_month(ts).alias("_month")).agg(counted)
    hours = F.explode(hour_steps(F.col("_month"), last_hour_of_month("_month"))).alias(ts)
    unfolded = skeleton.join(by_month, [key, "_month"], "left").select(hours, key, "_counted")
    return unfolded.select(ts, key, F.coalesce(F.col("_counted")[F.col(ts)], F.lit(0)).cast("int").alias(value))
