"""Exploratory profiles of the hourly table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.session import materialize

QUARTILES = (0.25, 0.5, 0.75)
#: Distinct values that a task sorts, at most about so many.
RANGE_VALUES = 1_000_000


def profile(df: DataFrame, key: str = "station_id", value: str = "pickups", ts: str = "timestamp") -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"),
        F.count_distinct(key).alias("stations"),
        F.min(ts).alias("first_hour"),
        F.max(ts).alias("last_hour"),
        F.sum(value).alias("total_pickups"),
    )


def values_at_ranks(counted: DataFrame, ranks: Sequence[int]) -> dict[int, float]:
    """The values at 0-based ranks of a sorted column that is given as distinct values ``v`` and counts ``n``.

    Values are dealt into ranges of about ``RANGE_VALUES`` distinct ones, which are counted; only ranges that hold a
    wanted rank are sorted. One row per range reaches the driver, and no task sees more than a range.
    """
    parts = max(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted.count() // RANGE_VALUES))
    ranged = materialize(counted.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    holds: dict[int, list[int]] = {}
    starts, before = {}, 0
    for row in sizes:
        inside = [r for r in set(ranks) if before <= r < before + row["n"]]
        if inside:
            holds[row["part"]], starts[row["part"]] = inside, before
        before += row["n"]
    if not holds:
        return {}
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for item in starts.items() for x in item]), F.col("part").cast("long"))
    last = start + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    ranked = ranged.where(F.col("part").isin([*holds])).select("v", (last - F.col("n")).alias("first"), last.alias("last"))
    wanted = F.explode(F.filter(F.array(*[F.lit(r).cast("long") for r in sorted({*ranks})]), lambda r: (r >= F.col("first")) & (r < F.col("last"))))
    return {r["rank"]: r["v"] for r in ranked.select("v", wanted.alias("rank")).collect()}


def describe_exact(df: DataFrame, value: str = "pickups") -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles (linear interpolation), maximum; one row.

    The built-in ``percentile`` keeps every distinct value in one task. Here values collapse into
    (value, count), which is written once; the quartiles are looked up in that.
    """
    number = F.col(value).cast("double")
    present = df.where(number.isNotNull() & ~F.isnan(number)).groupBy(number.alias("v"))
    counted = materialize(present.agg(F.count("*").alias("n")), "histogram")
    size, total = counted.agg(F.sum("n"), F.sum(F.col("n") * F.col("v"))).first()
    size = size or 0
    mean = total / size if size else None

    positions = {p: p * max(size - 1, 0) for p in QUARTILES}
    neighbours = {p: (int(at), min(int(at) + 1, max(size - 1, 0))) for p, at in positions.items()}
    at_rank = values_at_ranks(counted, [rank for pair in neighbours.values() for rank in pair])

    def quantile(p: float) -> float | None:
        low, high = (at_rank.get(rank) for rank in neighbours[p])
        return None if low is None else low + (high - low) * (positions[p] - int(positions[p]))

    deviation = F.col("v") - F.lit(mean).cast("double")
    return counted.agg(
        F.lit(size).cast("long").alias("count"),
        F.lit(mean).cast("double").alias("mean"),
        F.sqrt(F.try_divide(F.sum(F.col("n") * deviation * deviation), F.lit(size - 1))).alias("std"),
        F.min("v").alias("min"),
        *[F.lit(quantile(p)).cast("double").alias(f"p{int(p * 100)}") for p in QUARTILES],
        F.max("v").alias("max"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, nulls left out, most frequent first."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), F.asc(column))


def share_of_total(df: DataFrame, value: str, out: str) -> DataFrame:
    """Each row's part of the overall sum; the sum is a scalar subquery, not an unpartitioned window.

    ``df`` is an aggregate. It is written once, or what lies below it would run for the rows and the sum.
    """
    df = materialize(df, "shares")
    return df.withColumn(out, F.try_divide(F.col(value), df.agg(F.sum(value)).scalar()))


def hourly_profile(grid: DataFrame, ts: str = "timestamp", value: str = "pickups") -> DataFrame:
    """Mean system-wide demand by hour of day, weekdays and weekends side by side."""
    system = grid.groupBy(ts).agg(F.sum(value).alias(value))
    marked = system.select(F.hour(ts).alias("hour"), (F.weekday(ts) >= 5).alias("is_weekend"), value)
    pivoted = marked.groupBy("hour").pivot("is_weekend", [False, True]).agg(F.avg(value))
    return pivoted.withColumnsRenamed({"false": "Weekday", "true": "Weekend"})


def area_summary(located: DataFrame, keys: Sequence[str] = ("boroname", "ntaname")) -> DataFrame:
    """Stations, demand and share of demand per area; stations outside every area are left out."""
    by_area = located.na.drop(subset=list(keys)).groupBy(*keys).agg(
        F.count_distinct("station_id").alias("selected_stations"),
        F.sum("pickups").alias("total_pickups"),
        F.avg("pickups").alias("average_pickups_per_station"),
    )
    return share_of_total(by_area, "total_pickups", "pickup_share")


def daily_demand(grid: DataFrame, ts: str = "timestamp") -> DataFrame:
    return grid.groupBy(F.to_date(ts).alias("date")).agg(
        F.sum("pickups").alias("total_pickups"), F.avg("pickups").alias("mean_hourly_pickups")
    )


def daily_weather(weather: DataFrame, ts: str = "timestamp") -> DataFrame:
    return weather.groupBy(F.to_date(ts).alias("date")).agg(
        F.avg("temperature_c").alias("mean_temperature_c"),
        F.avg("apparent_temperature_c").alias("mean_apparent_temperature_c"),
        F.sum("precipitation_mm").alias("total_precipitation_mm"),
        F.avg("relative_humidity_pct").alias("mean_humidity_pct"),
        F.avg("wind_speed_kmh").alias("mean_wind_speed_kmh"),
    )
