"""Hourly weather responses: one JSON document of parallel arrays per download."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.operators.quality import (
    DataQualityError,
    duplicate_keys,
    require_complete_hours,
    require_empty,
    require_no_nulls,
)


def response_schema(names: Mapping[str, str]) -> T.StructType:
    def dtype(variable: str) -> T.DataType:
        if names[variable] == "timestamp":
            return T.StringType()
        return T.IntegerType() if names[variable] == "weather_code" else T.DoubleType()

    arrays = T.StructType([T.StructField(v, T.ArrayType(dtype(v))) for v in names])
    units = T.MapType(T.StringType(), T.StringType())
    return T.StructType([T.StructField("hourly", arrays), T.StructField("hourly_units", units)])


def read_responses(spark: SparkSession, path: str, names: Mapping[str, str], one_per_line: bool = False) -> DataFrame:
    """The documents as they are; ``one_per_line`` reads many documents from line-delimited files."""
    return spark.read.schema(response_schema(names)).option("multiLine", not one_per_line).json(path)


def require_variables(responses: DataFrame, names: Mapping[str, str]) -> None:
    """Every document has the hourly object and every variable in it."""
    absent = responses.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("hourly").isNull()).alias("hourly"),
        *[F.count_if(F.col("hourly").isNotNull() & F.col(f"hourly.{v}").isNull()).alias(f"v_{v}") for v in names],
    ).first()
    if absent["hourly"]:
        raise DataQualityError(f"{absent['hourly']:,} of {absent['documents']:,} weather documents have no 'hourly' object")
    lacking = [f"{v} in {absent[f'v_{v}']:,} of {absent['documents']:,} documents" for v in sorted(names) if absent[f"v_{v}"]]
    if lacking:
        raise DataQualityError(f"weather variables are absent: {', '.join(lacking)}")


def hourly_rows(responses: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """One row per array position with the renamed columns; shorter arrays are padded with nulls.

    Times are parsed strictly: a text that is no timestamp fails the job.
    """
    arrays = [F.col(f"hourly.{v}").alias(v) for v in names]
    rows = responses.select(*arrays).select(F.inline(F.arrays_zip(*names)))
    renamed = rows.withColumnsRenamed(dict(names)).select(*names.values())
    return renamed.withColumn("timestamp", F.to_timestamp_ntz("timestamp"))


def units(responses: DataFrame) -> DataFrame:
    return unit_counts(responses).select("variable", "unit")


def unit_counts(responses: DataFrame) -> DataFrame:
    """How many documents give each variable in each unit; a variable in two units must not be joined as one."""
    said = responses.select(F.explode("hourly_units").alias("variable", "unit"))
    return said.groupBy("variable", "unit").agg(F.count("*").alias("documents"))


def require_clean(weather: DataFrame) -> None:
    """No time twice and no value missing."""
    require_empty(duplicate_keys(weather, ["timestamp"]), "several weather rows claim the same hour")
    require_no_nulls(weather, weather.columns, "weather hours lack values")


def read_weather(spark: SparkSession, path: str, names: Mapping[str, str], first: datetime, last: datetime) -> DataFrame:
    """A checked hourly series that covers ``[first, last]`` exactly."""
    responses = read_responses(spark, path, names)
    require_variables(responses, names)
    weather = hourly_rows(responses, names)
    require_clean(weather)
    require_complete_hours(weather, "timestamp", first, last)
    return weather
