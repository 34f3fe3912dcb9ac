"""From trips to hourly counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.time import first_hour_of_month, floor_hour, next_month_start
from hourgrid.schemas import MISSING_TEXTS


def blank_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Texts that stand for a missing value become nulls."""
    return df.withColumns({c: F.when(~F.col(c).isin(*MISSING_TEXTS), F.col(c)) for c in columns})


def in_month(ts: str, month: str) -> Column:
    """Whether a time lies in the calendar month of ``month`` (half-open)."""
    return (F.col(ts) >= first_hour_of_month(month)) & (F.col(ts) < next_month_start(month))


def within_month(df: DataFrame, ts: str, month: str) -> DataFrame:
    return df.where(in_month(ts, month))


def between_times(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Half-open range ``start <= ts < end``; the bounds are literals, so the scan prunes row groups."""
    return df.where((F.col(ts) >= start) & (F.col(ts) < end))


def hourly_counts(
    trips: DataFrame,
    ts: str = "started_at",
    keys: Sequence[str] = ("start_station_id", "start_station_name"),
    out: str = "pickups",
) -> DataFrame:
    """Trips per hour and key; rows with a null time or key are dropped.

    Counting is partial before the shuffle, so a station with a third of all trips sends one row per
    hour and task, not its trips.
    """
    complete = trips.select(ts, *keys).na.drop()
    return complete.groupBy(floor_hour(ts).alias("timestamp"), *keys).agg(F.count("*").alias(out))


def sum_by(df: DataFrame, keys: Sequence[str], value: str = "pickups") -> DataFrame:
    """Totals by key; rows with a null key belong to no group."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.sum(value).alias(value))
