"""Parquet tables between the stages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.functions.time import month_label
from hourgrid.schemas import HOURLY_PICKUPS

MONTH = "month_label"


def require_input(spark: SparkSession, path: str, previous: str) -> None:
    """Fail early, and name the stage that writes the missing input. Lists the path, reads nothing."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"{path} not found; run the '{previous}' stage first") from error


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_monthly(df: DataFrame, path: str, ts: str = "timestamp", rebalance: bool = True) -> None:
    """A table partitioned by the month of ``ts``, so that a time filter opens only its months.

    Rebalancing shuffles rows to their month and lets adaptive execution split large months and merge
    small ones into files of the advisory size. Leave it out where tasks hold one month already.
    """
    monthly = df.withColumn(MONTH, month_label(ts))
    if rebalance:
        monthly = monthly.hint("rebalance", F.col(MONTH))
    monthly.write.mode("overwrite").partitionBy(MONTH).parquet(path)


def rewrite_months(df: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Replace the months that occur in ``df`` and leave all others of the table as they are."""
    monthly = df.withColumn(MONTH, month_label(ts)).hint("rebalance", F.col(MONTH))
    monthly.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def missing_months(spark: SparkSession, path: str) -> DataFrame:
    """Months between the first and the last of a monthly table that have no rows: the inputs of a report that would be short."""
    found = spark.read.schema(f"{MONTH} string").parquet(path).select(F.to_date(F.concat(MONTH, F.lit("-01"))).alias("month")).distinct()
    every = found.agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    return every.join(found, "month", "left_anti").select(F.date_format("month", "yyyy-MM").alias(MONTH))


def read_monthly(spark: SparkSession, path: str, schema: T.StructType = HOURLY_PICKUPS) -> DataFrame:
    return _monthly(spark, path, schema).drop(MONTH)


def read_months(
    spark: SparkSession, path: str, first: str, last: str, schema: T.StructType = HOURLY_PICKUPS
) -> DataFrame:
    """Months ``first`` to ``last`` (``YYYY-MM``), pruned at the partition level."""
    return _monthly(spark, path, schema).where(F.col(MONTH).between(first, last)).drop(MONTH)


def _monthly(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    # The label is given as text: inferred, "2024-01" would become a date.
    with_month = T.StructType([*schema.fields, T.StructField(MONTH, T.StringType())])
    return spark.read.schema(with_month).parquet(path)
