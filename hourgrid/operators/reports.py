"""Error breakdowns: by day, hour and station, largest misses, inactive stations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions import errors
from hourgrid.functions.time import month_label
from hourgrid.operators.joins import keep_listed


def error_frame(df: DataFrame, prediction: str, keep: Sequence[str], actual: str = "pickups") -> DataFrame:
    """The kept columns, the prediction clipped at zero, and its error, absolute and squared error."""
    clipped = df.select(*keep, errors.clip_at_zero(F.col(prediction).cast("double")).alias("prediction"))
    error = F.col("prediction") - F.col(actual)
    return clipped.withColumns({"error": error, "absolute_error": F.abs(error), "squared_error": error * error})


def error_by(frame: DataFrame, keys: Sequence[str], actual: str = "pickups") -> DataFrame:
    """Actual and predicted totals, MAE, RMSE, bias, total and relative error per group."""
    grouped = frame.na.drop(subset=list(keys)).groupBy(*keys).agg(
        F.sum(actual).alias("actual_pickups"),
        F.sum("prediction").alias("predicted_pickups"),
        F.avg("absolute_error").alias("mae"),
        F.sqrt(F.avg("squared_error")).alias("rmse"),
        F.avg("error").alias("bias"),
    )
    total_error = F.col("predicted_pickups") - F.col("actual_pickups")
    return grouped.withColumns(
        {"total_error": total_error, "relative_error_pct": errors.relative_pct(total_error, F.col("actual_pickups"))}
    )


def prediction_range(frame: DataFrame, actual: str = "pickups") -> DataFrame:
    """Means of prediction and actual, extremes of the prediction, maximum of the actual."""
    return frame.agg(
        F.avg(actual).alias("actual_mean"),
        F.avg("prediction").alias("predicted_mean"),
        F.min("prediction").alias("predicted_min"),
        F.max("prediction").alias("predicted_max"),
        F.max(actual).alias("actual_max"),
    )


def daily_weather_of(frame: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Weather per day from rows that repeat it for every station: each hour counts once."""
    hours = frame.select(ts, "temperature_c", "precipitation_mm", "is_precipitating").dropDuplicates([ts])
    return hours.groupBy(F.to_date(ts).alias("date")).agg(
        F.avg("temperature_c").alias("mean_temperature_c"),
        F.sum("precipitation_mm").alias("total_precipitation_mm"),
        F.sum("is_precipitating").alias("precipitating_hours"),
    )


def errors_by_day_with_weather(frame: DataFrame, ts: str = "timestamp") -> DataFrame:
    """``frame`` is read for the errors and for the weather; hand in a written one."""
    daily = error_by(frame.withColumn("date", F.to_date(ts)), ["date"])
    return daily.join(daily_weather_of(frame, ts), "date")


def mean_errors_by(
    df: DataFrame, keys: Sequence[str], predictions: Mapping[str, str], actual: str = "pickups"
) -> DataFrame:
    """Mean absolute error of several prediction columns side by side, with the group's demand."""
    y = F.col(actual)
    columns = [errors.mae(y, F.col(c)).alias(f"{label}_mae") for label, c in predictions.items()]
    return df.groupBy(*keys).agg(
        *columns, F.avg(actual).alias("average_pickups"), F.max(actual).alias("max_pickups")
    )


def largest_misses(frame: DataFrame, n: int = 20, ts: str = "timestamp", key: str = "station_id") -> DataFrame:
    """The ``n`` largest absolute errors; equal ones in order of time and key."""
    return frame.orderBy(F.desc("absolute_error"), F.asc(ts), F.asc(key)).limit(n)


def misses_by_direction(misses: DataFrame) -> DataFrame:
    return misses.groupBy(errors.direction(F.col("error")).alias("direction")).agg(
        F.count("absolute_error").alias("count"),
        F.avg("absolute_error").alias("mean_absolute_error"),
        F.max("absolute_error").alias("max_absolute_error"),
    )


def misses_by_hour(misses: DataFrame, ts: str = "timestamp") -> DataFrame:
    counted = misses.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("count_in_top"))
    return counted.orderBy(F.desc("count_in_top"), "hour")


def active(by_station: DataFrame) -> DataFrame:
    return by_station.where("actual_pickups > 0")


def inactive(by_station: DataFrame) -> DataFrame:
    return by_station.where("actual_pickups = 0")


def worst(by_station: DataFrame, n: int = 10, key: str = "station_id") -> DataFrame:
    """The ``n`` active stations with the highest MAE."""
    return active(by_station).orderBy(F.desc("mae"), F.asc(key)).limit(n)


def monthly_activity(grid: DataFrame, stations: DataFrame, ts: str = "timestamp", key: str = "station_id") -> DataFrame:
    """Monthly totals and active hours of the listed stations over their whole history.

    Months are summed before the stations are looked up, so that no row of the grid is shuffled for a long list.
    """
    months = grid.groupBy(key, "station_name", month_label(ts).alias("year_month")).agg(
        F.sum("pickups").alias("total_pickups"),
        F.count_if(F.col("pickups") > 0).alias("active_hours"),
        F.count("pickups").alias("total_hours"),
    )
    return keep_listed(months, stations, key)
