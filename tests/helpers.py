"""Small frames and pandas re-computations the tests compare with."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hourgrid.functions.time import naive


def hours(first: str, count: int) -> list[datetime]:
    start = datetime.fromisoformat(first)
    return [start + timedelta(hours=i) for i in range(count)]


def frame(spark, rows, schema: str):
    """Rows with datetimes as naive timestamps."""
    return spark.createDataFrame(rows, schema)


def dense(spark, stations: int, count: int, first: str = "2024-01-01", seed: int = 1):
    """A dense pickup table of ``stations`` x ``count`` hours, as Spark and as pandas."""
    rng = np.random.default_rng(seed)
    stamps = hours(first, count)
    pdf = pd.DataFrame(
        {
            "timestamp": np.tile(stamps, stations),
            "station_id": np.repeat([f"s{i}" for i in range(stations)], count),
            "pickups": rng.poisson(4, stations * count).astype("int32"),
        }
    )
    pdf["station_name"] = "name " + pdf["station_id"]
    rows = [(t.to_pydatetime(), s, n, int(p)) for t, s, n, p in pdf[["timestamp", "station_id", "station_name", "pickups"]].itertuples(index=False)]
    return frame(spark, rows, "timestamp timestamp_ntz, station_id string, station_name string, pickups int"), pdf


def weather_for(spark, first: str, count: int):
    stamps = hours(first, count)
    rows = [(t, 10.0 + i % 24, 9.0, 50.0, float(i % 5 == 0), 12.0, i % 3) for i, t in enumerate(stamps)]
    return frame(
        spark,
        rows,
        "timestamp timestamp_ntz, temperature_c double, apparent_temperature_c double, relative_humidity_pct double,"
        " precipitation_mm double, wind_speed_kmh double, weather_code int",
    )


def at(df, ts: str):
    return df.where(F.col("timestamp") == naive(ts))
