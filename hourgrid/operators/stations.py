"""The station dimension: one name and one coordinate per station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.operators.ranking import canonical_label


def station_metadata(points: DataFrame) -> DataFrame:
    """Mean coordinate per (station, name); the name seen most often wins.

    ``points`` has ``start_station_id, start_station_name, start_lat, start_lng``, one row per trip.
    """
    named = points.na.drop(subset=["start_station_id", "start_station_name", "start_lat", "start_lng"])
    means = named.groupBy(
        F.col("start_station_id").alias("station_id"), F.col("start_station_name").alias("station_name")
    ).agg(
        F.avg("start_lat").alias("latitude"),
        F.avg("start_lng").alias("longitude"),
        F.count("*").alias("observations"),
    )
    return canonical_label(means, "station_id", "station_name", "observations", ("latitude", "longitude"))
