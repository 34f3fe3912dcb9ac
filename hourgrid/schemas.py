"""Column names and types of the tables that pass between the stages.

All times are naive local times (``timestamp_ntz``): a session time zone must never move a trip into
another hour or drop the hour that daylight saving skips.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the trip files.
TRIP_COLUMNS = ("started_at", "start_station_id", "start_station_name")
POINT_COLUMNS = ("start_station_id", "start_station_name", "start_lat", "start_lng")

HOURLY_PICKUPS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("station_id", T.StringType()),
        T.StructField("station_name", T.StringType()),
        T.StructField("pickups", T.IntegerType()),
    ]
)

# The weather measures of every stage after the response.
WEATHER_MEASURES = (
    "temperature_c",
    "apparent_temperature_c",
    "relative_humidity_pct",
    "precipitation_mm",
    "wind_speed_kmh",
    "weather_code",
)

# Variable names of the weather service's hourly response, and the column each becomes.
OBSERVED_WEATHER_NAMES = {
    "time": "timestamp",
    "temperature_2m": "temperature_c",
    "apparent_temperature": "apparent_temperature_c",
    "relative_humidity_2m": "relative_humidity_pct",
    "precipitation": "precipitation_mm",
    "wind_speed_10m": "wind_speed_kmh",
    "weather_code": "weather_code",
}

# The service marks a forecast issued one day earlier with this suffix on every variable but the time.
DAY_AHEAD_SUFFIX = "_previous_day1"
DAY_AHEAD_WEATHER_NAMES = {
    (name if name == "time" else name + DAY_AHEAD_SUFFIX): column
    for name, column in OBSERVED_WEATHER_NAMES.items()
}

# Cell texts that count as missing in the trip files.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Names and parameters of the model features.
CALENDAR_FEATURES = (
    "hour",
    "day_of_week",
    "month",
    "is_weekend",
    "hour_sin",
    "hour_cos",
    "day_of_week_sin",
    "day_of_week_cos",
)
LAGS = (24, 48, 168, 336)
ROLLING_HOURS = 168
ROLLING_SHIFT = 24
LAG_FEATURES = tuple(f"lag_{k}" for k in LAGS)
ROLLING_FEATURES = (f"rolling_mean_{ROLLING_HOURS}", f"rolling_std_{ROLLING_HOURS}")
HISTORY_FEATURES = LAG_FEATURES + ROLLING_FEATURES

CATEGORICAL_FEATURE = "station_id"
BASE_NUMERIC_FEATURES = CALENDAR_FEATURES + HISTORY_FEATURES
WEATHER_FEATURES = WEATHER_MEASURES + ("is_precipitating",)

# Seasonal baselines: label of the forecast and the column that holds it.
BASELINES = {"yesterday": "lag_24", "last_week": "lag_168"}
