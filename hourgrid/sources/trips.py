"""Trip and station-point scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hourgrid.operators.counts import blank_to_null, in_month
from hourgrid.schemas import POINT_COLUMNS, TRIP_COLUMNS
from hourgrid.sources import archives


def archive_month(name: Column | str) -> Column:
    """First hour of the month an archive is named after (``YYYYMM...``)."""
    return F.to_date(F.substring(name, 1, 6), "yyyyMM").cast("timestamp_ntz")


def read_text_columns(spark: SparkSession, location: str, columns: Sequence[str], zipped: bool) -> DataFrame:
    """The listed columns as text, with the name of the file each row came from as ``archive``.

    Only these columns are parsed, from ZIP archives or from extracted CSV files, whose names begin with their month too.
    """
    archives.register(spark)
    schema = ", ".join(f"{c} string" for c in [*columns, "archive"])
    files = archives.ARCHIVE_GLOB if zipped else archives.CSV_GLOB
    return blank_to_null(spark.read.format("zip_csv").schema(schema).option("files", files).load(location), columns)


#: What keeps a line of a trip file from being a trip, in the order in which it is looked for.
UNREADABLE, INCOMPLETE, OTHER_MONTH = "time cannot be read", "incomplete", "another month"


def _judged(spark: SparkSession, location: str, zipped: bool) -> DataFrame:
    """Every line with its time as text and parsed, and why it is no trip, if it is none."""
    text = read_text_columns(spark, location, TRIP_COLUMNS, zipped).withColumn("time_text", F.col("started_at"))
    typed = text.withColumns({"started_at": F.expr("try_cast(started_at as timestamp_ntz)"), "archive_month": archive_month("archive")})
    incomplete = F.lit(False)
    for column in TRIP_COLUMNS:
        incomplete = incomplete | F.col(column).isNull()
    unreadable = F.col("time_text").isNotNull() & F.col("started_at").isNull()
    reason = F.when(unreadable, UNREADABLE).when(incomplete, INCOMPLETE).when(~in_month("started_at", "archive_month"), OTHER_MONTH)
    return typed.withColumn("reason", reason)


def read_trips(spark: SparkSession, location: str, zipped: bool = True, seen: Observation | None = None) -> DataFrame:
    """Trips with a time, a station id and a name, inside the month their file is named after.

    ``seen`` counts, with the job that reads the trips, the ``lines`` and those that are no trips: ``unreadable``,
    ``incomplete``, ``other_month``.
    """
    judged = _judged(spark, location, zipped)
    if seen is not None:
        left_out = {"unreadable": UNREADABLE, "incomplete": INCOMPLETE, "other_month": OTHER_MONTH}
        counts = [F.count_if(F.col("reason") == reason).alias(name) for name, reason in left_out.items()]
        judged = judged.observe(seen, F.count(F.lit(1)).alias("lines"), *counts)
    return judged.where("reason IS NULL").select(*TRIP_COLUMNS)


def rejected_trips(spark: SparkSession, location: str, zipped: bool = True) -> DataFrame:
    """The lines that are no trips, as text, with their file and the ``reason``."""
    rejected = _judged(spark, location, zipped).where("reason IS NOT NULL").withColumn("started_at", F.col("time_text"))
    return rejected.select("archive", *TRIP_COLUMNS, "reason")


def read_station_points(spark: SparkSession, location: str, zipped: bool = True) -> DataFrame:
    """Station id, name and coordinate of every trip, as the station dimension needs them."""
    text = read_text_columns(spark, location, POINT_COLUMNS, zipped)
    numbers = {c: F.expr(f"try_cast({c} as double)") for c in ("start_lat", "start_lng")}
    return text.withColumns(numbers).select(*POINT_COLUMNS)
