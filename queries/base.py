"""Stand-ins: how the given tables play trips, stations and weather, in Spark and in SQL.

``events`` plays the trips: ``ts`` is the start time, ``user_id`` the station, ``event_type`` its name (one
station has several names). The weather is aggregated from the same events over every hour of the month.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.functions.time import floor_hour, hour_steps
from hourgrid.operators.counts import hourly_counts, sum_by
from hourgrid.operators.grid import dense_grid, grid_bounds
from hourgrid.operators.history import add_history
from hourgrid.plans.dataset import build_dataset
from hourgrid.plans.features import add_calendar_features, build_features
from hourgrid.schemas import BASE_NUMERIC_FEATURES, HISTORY_FEATURES, WEATHER_FEATURES, WEATHER_MEASURES
from hourgrid.session import materialize

CUTOFF = date(2024, 1, 25)
TOP_N = 10
FOLD_STARTS = (date(2024, 1, 16), date(2024, 1, 19), date(2024, 1, 22))
FOLD_DAYS = 3
TEST_START = date(2024, 1, 25)
TEST_END = date(2024, 2, 1)
TEST_ROWS = 7 * 24 * TOP_N


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places`` digits, small integers widened, so both engines print the same value."""
    def same(f: T.StructField):
        if isinstance(f.dataType, T.DoubleType):
            return F.round(f.name, places).alias(f.name)
        if isinstance(f.dataType, T.ByteType):
            return F.col(f.name).cast("int").alias(f.name)
        return F.col(f.name)

    return df.select(*[same(f) for f in df.schema.fields])


def r(expression: str, places: int = 6) -> str:
    """The SQL of ``rounded``; a negative zero becomes zero."""
    value = f"round({expression}, {places})"
    return f"(CASE WHEN {value} = 0 THEN CAST(0 AS DOUBLE) ELSE {value} END)"


def with_ctes(*names: str, tail: str) -> str:
    """A statement with the named common table expressions, and those they need, in order."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in CTE_NEEDS.get(name, ()):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in wanted) + "\n" + tail


# --- Spark stand-ins -------------------------------------------------------------------------------


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("started_at"),
        F.col("user_id").cast("string").alias("start_station_id"),
        F.col("event_type").alias("start_station_name"),
    )


def hourly_by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per hour and station, all stations."""
    return hourly_counts(trips(spark, sf_dir), keys=["start_station_id"]).withColumnRenamed("start_station_id", "station_id")


def hourly_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"start_station_id": "station_id", "start_station_name": "station_name"}
    return hourly_counts(trips(spark, sf_dir)).withColumnsRenamed(names)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense table of the busiest stations, written once as its own stage writes it."""
    return materialize(build_dataset(trips(spark, sf_dir), CUTOFF, TOP_N), "grid")


def grid_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense table of every station."""
    hourly = materialize(hourly_by_station(spark, sf_dir), "hourly")
    stations = materialize(hourly.select("station_id").distinct(), "stations")
    return dense_grid(hourly, stations, "station_id", "pickups")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six hourly measures of the events, zero in hours without any."""
    value = F.col("value")
    hourly = (
        table(spark, sf_dir, "events")
        .groupBy(floor_hour("ts").alias("timestamp"))
        .agg(
            F.avg(value).alias("temperature_c"),
            F.min(value).alias("apparent_temperature_c"),
            F.max(value).alias("relative_humidity_pct"),
            F.sum(F.when(F.col("event_type") == "error", value).otherwise(0.0)).alias("precipitation_mm"),
            F.count("*").cast("double").alias("wind_speed_kmh"),
            F.count_if(F.col("event_type") == "click").cast("int").alias("weather_code"),
        )
    )
    staged = materialize(hourly, "weather")
    hours = grid_bounds(staged).select(F.explode(hour_steps(F.col("first_hour"), F.col("last_hour"))).alias("timestamp"))
    return hours.join(staged, "timestamp", "left").na.fill(0)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the feature table without its weather, which the baselines do not look at."""
    rows = add_history(grid(spark, sf_dir), "station_id", "pickups")
    return add_calendar_features(rows.na.drop(subset=list(HISTORY_FEATURES)))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_features(grid(spark, sf_dir), weather(spark, sf_dir))


def staged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table as its own stage writes it, for queries that read it repeatedly."""
    return materialize(features(spark, sf_dir), "features")


def station_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_by(hourly_by_station(spark, sf_dir), ["station_id"])


# --- the same in SQL -------------------------------------------------------------------------------

HISTORY_SQL = """
lag(pickups, 24) OVER w AS lag_24, lag(pickups, 48) OVER w AS lag_48,
lag(pickups, 168) OVER w AS lag_168, lag(pickups, 336) OVER w AS lag_336,
CASE WHEN count(pickups) OVER f = 168 THEN avg(pickups) OVER f END AS rolling_mean_168,
CASE WHEN count(pickups) OVER f = 168 THEN stddev_samp(pickups) OVER f END AS rolling_std_168
"""
HISTORY_WINDOWS = """
WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp"),
f AS (PARTITION BY station_id ORDER BY "timestamp" ROWS BETWEEN 191 PRECEDING AND 24 PRECEDING)
"""
CALENDAR_SQL = """
CAST(hour("timestamp") AS INTEGER) AS hour, CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
CAST(month("timestamp") AS INTEGER) AS month, CAST(isodow("timestamp") >= 6 AS INTEGER) AS is_weekend,
sin(2 * pi() * hour("timestamp") / 24) AS hour_sin, cos(2 * pi() * hour("timestamp") / 24) AS hour_cos,
sin(2 * pi() * (isodow("timestamp") - 1) / 7) AS day_of_week_sin,
cos(2 * pi() * (isodow("timestamp") - 1) / 7) AS day_of_week_cos
"""
FOLDS_SQL = ", ".join(f"(DATE '{d}')" for d in FOLD_STARTS)

CTE_NEEDS: Mapping[str, tuple[str, ...]] = {
    "by_station": ("by_name",),
    "names": ("by_name",),
    "top": ("by_station",),
    "hours": ("by_station", "top"),
    "grid": ("hours", "names"),
    "all_hours": ("by_station",),
    "grid_all": ("all_hours",),
    "weather": ("all_hours",),
    "history": ("grid",),
    "history_all": ("grid_all",),
    "features": ("history", "weather"),
    "test": ("features",),
    "errors": ("test",),
    "folds": ("features",),
    "fold_metrics": ("folds",),
    "summary": ("fold_metrics",),
    "station_errors": ("errors",),
    "misses": ("errors",),
}

CTES: Mapping[str, str] = {
    "by_name": """
SELECT date_trunc('hour', ts) AS "timestamp", CAST(user_id AS VARCHAR) AS station_id,
       event_type AS station_name, count(*) AS pickups
FROM events GROUP BY ALL""",
    "by_station": """
SELECT "timestamp", station_id, CAST(sum(pickups) AS BIGINT) AS pickups FROM by_name GROUP BY ALL""",
    "names": """
SELECT station_id, station_name FROM (
  SELECT station_id, station_name,
         row_number() OVER (PARTITION BY station_id ORDER BY sum(pickups) DESC, station_name) AS rn
  FROM by_name GROUP BY station_id, station_name) WHERE rn = 1""",
    "top": f"""
SELECT station_id, CAST(sum(pickups) AS BIGINT) AS total FROM by_station
WHERE "timestamp" < TIMESTAMP '{CUTOFF} 00:00:00'
GROUP BY station_id ORDER BY total DESC, station_id LIMIT {TOP_N}""",
    "hours": """
SELECT unnest(generate_series(date_trunc('month', lo)::TIMESTAMP,
                              last_day(hi)::TIMESTAMP + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS "timestamp"
FROM (SELECT min("timestamp") AS lo, max("timestamp") AS hi FROM by_station
      WHERE station_id IN (SELECT station_id FROM top))""",
    "grid": """
SELECT h."timestamp", t.station_id, n.station_name, CAST(coalesce(b.pickups, 0) AS INTEGER) AS pickups
FROM hours h CROSS JOIN top t
LEFT JOIN by_station b ON b."timestamp" = h."timestamp" AND b.station_id = t.station_id
LEFT JOIN names n ON n.station_id = t.station_id""",
    "all_hours": """
SELECT unnest(generate_series(date_trunc('month', min("timestamp"))::TIMESTAMP,
                              last_day(max("timestamp"))::TIMESTAMP + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS "timestamp"
FROM by_station""",
    "grid_all": """
SELECT h."timestamp", s.station_id, CAST(coalesce(b.pickups, 0) AS INTEGER) AS pickups
FROM all_hours h CROSS JOIN (SELECT DISTINCT station_id FROM by_station) s
LEFT JOIN by_station b ON b."timestamp" = h."timestamp" AND b.station_id = s.station_id""",
    "weather": """
SELECT h."timestamp",
       coalesce(w.temperature_c, 0) AS temperature_c, coalesce(w.apparent_temperature_c, 0) AS apparent_temperature_c,
       coalesce(w.relative_humidity_pct, 0) AS relative_humidity_pct, coalesce(w.precipitation_mm, 0) AS precipitation_mm,
       coalesce(w.wind_speed_kmh, 0) AS wind_speed_kmh, coalesce(w.weather_code, 0) AS weather_code
FROM all_hours h LEFT JOIN (
  SELECT date_trunc('hour', ts) AS "timestamp", avg(value) AS temperature_c, min(value) AS apparent_temperature_c,
         max(value) AS relative_humidity_pct,
         sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS precipitation_mm,
         CAST(count(*) AS DOUBLE) AS wind_speed_kmh,
         CAST(count(*) FILTER (WHERE event_type = 'click') AS INTEGER) AS weather_code
  FROM events GROUP BY 1) w ON w."timestamp" = h."timestamp\"""",
    "history": f"""SELECT *, {HISTORY_SQL} FROM grid {HISTORY_WINDOWS}""",
    "history_all": f"""SELECT *, {HISTORY_SQL} FROM grid_all {HISTORY_WINDOWS}""",
    "features": f"""
SELECT g.*, w.* EXCLUDE ("timestamp"), CAST(w.precipitation_mm > 0 AS INTEGER) AS is_precipitating, c.* EXCLUDE ("timestamp")
FROM history g
LEFT JOIN weather w ON w."timestamp" = g."timestamp"
LEFT JOIN (SELECT "timestamp", {CALENDAR_SQL} FROM all_hours) c ON c."timestamp" = g."timestamp"
WHERE g.lag_336 IS NOT NULL AND g.rolling_mean_168 IS NOT NULL AND g.rolling_std_168 IS NOT NULL""",
    "test": f"""
SELECT * FROM features
WHERE "timestamp" >= TIMESTAMP '{TEST_START} 00:00:00' AND "timestamp" < TIMESTAMP '{TEST_END} 00:00:00'""",
    "errors": """
SELECT *, greatest(CAST(lag_168 AS DOUBLE), 0.0) AS prediction, lag_168 - pickups AS error,
       abs(lag_168 - pickups) AS absolute_error, (lag_168 - pickups) * (lag_168 - pickups) AS squared_error
FROM test""",
    "folds": f"""
SELECT f.start AS validation_week, x.* FROM (VALUES {FOLDS_SQL}) f(start)
JOIN features x ON x."timestamp" >= f.start AND x."timestamp" < f.start + INTERVAL {FOLD_DAYS} DAY""",
    "fold_metrics": """
SELECT validation_week, 'yesterday' AS model, avg(abs(lag_24 - pickups)) AS MAE,
       sqrt(avg((lag_24 - pickups) * (lag_24 - pickups))) AS RMSE FROM folds GROUP BY validation_week
UNION ALL
SELECT validation_week, 'last_week', avg(abs(lag_168 - pickups)),
       sqrt(avg((lag_168 - pickups) * (lag_168 - pickups))) FROM folds GROUP BY validation_week""",
    "summary": """
SELECT model, avg(MAE) AS mean_MAE, stddev_samp(MAE) AS std_MAE, avg(RMSE) AS mean_RMSE, stddev_samp(RMSE) AS std_RMSE
FROM fold_metrics GROUP BY model""",
    "station_errors": """
SELECT station_id, station_name, CAST(sum(pickups) AS BIGINT) AS actual_pickups, sum(prediction) AS predicted_pickups,
       avg(absolute_error) AS mae, sqrt(avg(squared_error)) AS rmse, avg(error) AS bias
FROM errors GROUP BY ALL""",
    "misses": """
SELECT * FROM errors ORDER BY absolute_error DESC, "timestamp", station_id LIMIT 20""",
}

DOUBLE_FEATURES = (
    *[c for c in BASE_NUMERIC_FEATURES if c.endswith(("_sin", "_cos")) or c.startswith("rolling")],
    *[c for c in WEATHER_MEASURES if c != "weather_code"],
)


def rounded_columns(columns) -> str:
    """A select list that rounds the feature columns that are doubles."""
    return ", ".join(f"{r(c)} AS {c}" if c in DOUBLE_FEATURES else f'"{c}"' for c in columns)


FEATURE_COLUMNS = ("timestamp", "station_id", "station_name", "pickups", *BASE_NUMERIC_FEATURES, *WEATHER_FEATURES)
assert len(FEATURE_COLUMNS) == 25 and set(HISTORY_FEATURES) <= set(FEATURE_COLUMNS)
