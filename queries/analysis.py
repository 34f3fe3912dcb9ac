"""Profiles and error reports. The forecast under analysis is the last-week baseline."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.errors import gain_label, half_even
from hourgrid.functions.time import naive
from hourgrid.operators import profile as profiles
from hourgrid.operators import reports
from hourgrid.operators.counts import sum_by
from hourgrid.operators.evaluation import fixed_test
from hourgrid.operators.grid import dense_grid
from hourgrid.operators.joins import join_checked
from hourgrid.schemas import BASELINES
from hourgrid.session import materialize
from queries import base
from queries.base import Query, r, rounded, table, with_ctes

KEPT = ("timestamp", "station_id", "station_name", "pickups", "hour")
WEATHER_KEPT = ("temperature_c", "precipitation_mm", "is_precipitating")


def test_rows(spark, sf_dir) -> DataFrame:
    return fixed_test(base.history(spark, sf_dir), base.TEST_START, base.TEST_END)


def frame(spark, sf_dir) -> DataFrame:
    return reports.error_frame(test_rows(spark, sf_dir), "lag_168", KEPT)


def frame_with_weather(spark, sf_dir) -> DataFrame:
    test = fixed_test(base.features(spark, sf_dir), base.TEST_START, base.TEST_END)
    return reports.error_frame(test, "lag_168", KEPT + WEATHER_KEPT)


def station_errors(spark, sf_dir) -> DataFrame:
    return reports.error_by(frame(spark, sf_dir), ["station_id", "station_name"])


def misses(spark, sf_dir) -> DataFrame:
    return reports.largest_misses(frame(spark, sf_dir))


def daily_join(spark, sf_dir) -> DataFrame:
    """Daily demand and daily weather of a closed range of days."""
    demand = profiles.daily_demand(base.grid(spark, sf_dir))
    days = join_checked(demand, profiles.daily_weather(base.weather(spark, sf_dir)), "date", "inner", "one_to_one")
    return rounded(days.where(F.col("date").between(F.lit(date(2024, 1, 24)), F.lit(date(2024, 1, 30)))))


def hourly_join(spark, sf_dir) -> DataFrame:
    """Hourly totals and weather of a closed range of hours."""
    totals = sum_by(base.grid(spark, sf_dir), ["timestamp"]).withColumnRenamed("pickups", "total_pickups")
    hours = join_checked(totals, base.weather(spark, sf_dir), "timestamp", "inner", "one_to_one")
    storm = hours.where(F.col("timestamp").between(naive("2024-01-24 00:00:00"), naive("2024-01-26 23:00:00")))
    return rounded(storm.select("timestamp", "total_pickups", "precipitation_mm"))


def shares(spark, sf_dir) -> DataFrame:
    return rounded(profiles.share_of_total(base.station_totals(spark, sf_dir), "pickups", "share"))


def areas(spark, sf_dir) -> DataFrame:
    """Customers per nation and region play stations per neighbourhood and borough; one area is unknown."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("pickups"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    located = customers.join(orders, "c_custkey").join(nations, "n_nationkey").select(
        F.col("c_custkey").cast("string").alias("station_id"),
        "pickups",
        F.nullif("r_name", F.lit("ASIA")).alias("boroname"),
        F.col("n_name").alias("ntaname"),
    )
    return rounded(profiles.area_summary(located))


def grid_of_pairs(spark, sf_dir) -> DataFrame:
    """The dense table of every station and name as a station of its own."""
    named = base.hourly_by_name(spark, sf_dir).withColumn("station_id", F.concat_ws("-", "station_id", "station_name"))
    hourly = materialize(named.select("timestamp", "station_id", "pickups"), "hourly")
    grid = dense_grid(hourly, materialize(hourly.select("station_id").distinct(), "stations"), "station_id", "pickups")
    return materialize(grid.withColumn("station_name", F.concat(F.lit("S"), "station_id")), "grid")


def inactive_monthly(spark, sf_dir) -> DataFrame:
    """Stations without a trip in the whole test period, and what they did month by month."""
    grid = grid_of_pairs(spark, sf_dir)
    test = fixed_test(grid, base.TEST_START, base.TEST_END).withColumn("prediction", F.lit(0.0))
    errors = reports.error_by(reports.error_frame(test, "prediction", ["station_id", "pickups"]), ["station_id"])
    return reports.monthly_activity(grid, reports.inactive(errors), key="station_id")


def drift_errors(spark, sf_dir) -> DataFrame:
    """Errors of a forecast that goes on with the change since last week and falls below zero, where it is clipped."""
    drifting = test_rows(spark, sf_dir).withColumn("drift", 2 * F.col("lag_24") - F.col("lag_168"))
    return rounded(reports.error_frame(drifting, "drift", ["timestamp", "station_id", "pickups", "drift"]))


def one_entity(spark, sf_dir) -> DataFrame:
    """All test rows of the stations of one name, as a report with half-even rounding."""
    return test_rows(spark, sf_dir).where(F.col("station_name") == "click").select(
        "timestamp", "station_id", "pickups", "lag_24", "lag_168", half_even(F.col("rolling_mean_168"), 2).alias("rolling_mean")
    )


def preview(spark, sf_dir) -> DataFrame:
    """The first rows of the whole test table; the limit is the feature."""
    return test_rows(spark, sf_dir).orderBy("station_id", "timestamp").limit(175).select("timestamp", "station_id", "pickups", "lag_24", "lag_168")


def worst_rounded(spark, sf_dir) -> DataFrame:
    return rounded(reports.worst(station_errors(spark, sf_dir), 10).select("station_id", "mae"), 2)


ERROR_COLUMNS = f"""CAST(sum(pickups) AS BIGINT) AS actual_pickups, {r("sum(prediction)")} AS predicted_pickups,
    {r("avg(absolute_error)")} AS mae, {r("sqrt(avg(squared_error))")} AS rmse, {r("avg(error)")} AS bias,
    {r("sum(prediction) - sum(pickups)")} AS total_error,
    {r("CASE WHEN sum(pickups) <> 0 THEN (sum(prediction) - sum(pickups)) / sum(pickups) * 100 END")} AS relative_error_pct"""

MEAN_ERROR_COLUMNS = f"""{r("avg(abs(lag_24 - pickups))")} AS yesterday_mae, {r("avg(abs(lag_168 - pickups))")} AS last_week_mae,
    {r("avg(pickups)")} AS average_pickups, max(pickups) AS max_pickups"""

QUERIES = {
    "profile": Query(
        lambda spark, sf_dir: profiles.profile(base.grid_of_all(spark, sf_dir)),
        with_ctes(
            "grid_all",
            tail="""SELECT count(*) AS "rows", count(DISTINCT station_id) AS stations, min("timestamp") AS first_hour,
                    max("timestamp") AS last_hour, CAST(sum(pickups) AS BIGINT) AS total_pickups FROM grid_all""",
        ),
    ),
    "describe_exact": Query(
        lambda spark, sf_dir: rounded(profiles.describe_exact(base.grid_of_all(spark, sf_dir))),
        with_ctes(
            "grid_all",
            tail=f"""SELECT count(pickups) AS "count", {r("avg(pickups)")} AS mean, {r("stddev_samp(pickups)")} AS std,
                CAST(min(pickups) AS DOUBLE) AS "min", {r("quantile_cont(pickups, 0.25)")} AS p25,
                {r("quantile_cont(pickups, 0.5)")} AS p50, {r("quantile_cont(pickups, 0.75)")} AS p75,
                CAST(max(pickups) AS DOUBLE) AS "max" FROM grid_all""",
        ),
    ),
    "describe_exact_continuous": Query(
        lambda spark, sf_dir: rounded(profiles.describe_exact(table(spark, sf_dir, "lineitem"), "l_extendedprice"), 4),
        f"""SELECT count(l_extendedprice) AS "count", {r("avg(l_extendedprice)", 4)} AS mean,
            {r("stddev_samp(l_extendedprice)", 4)} AS std, {r("min(l_extendedprice)", 4)} AS "min",
            {r("quantile_cont(l_extendedprice, 0.25)", 4)} AS p25, {r("quantile_cont(l_extendedprice, 0.5)", 4)} AS p50,
            {r("quantile_cont(l_extendedprice, 0.75)", 4)} AS p75, {r("max(l_extendedprice)", 4)} AS "max" FROM lineitem""",
    ),
    "value_counts": Query(
        lambda spark, sf_dir: profiles.value_counts(
            table(spark, sf_dir, "events").withColumn("event_type", F.nullif("event_type", F.lit("view"))), "event_type"
        ),
        """SELECT event_type, count(*) AS "count" FROM events WHERE event_type <> 'view' GROUP BY 1""",
    ),
    "hourly_profile_pivot": Query(
        lambda spark, sf_dir: rounded(profiles.hourly_profile(base.grid(spark, sf_dir))),
        with_ctes(
            "grid",
            tail=f"""SELECT CAST(hour("timestamp") AS INTEGER) AS hour,
                {r("avg(p) FILTER (WHERE isodow(timestamp) < 6)")} AS "Weekday",
                {r("avg(p) FILTER (WHERE isodow(timestamp) >= 6)")} AS "Weekend"
                FROM (SELECT "timestamp", sum(pickups) AS p FROM grid GROUP BY 1) GROUP BY 1""",
        ),
    ),
    "share_of_total": Query(
        shares,
        with_ctes(
            "by_station",
            tail=f"""SELECT station_id, CAST(sum(pickups) AS BIGINT) AS pickups,
                {r("sum(pickups) / sum(sum(pickups)) OVER ()")} AS share FROM by_station GROUP BY 1""",
        ),
    ),
    "neighborhood_summary": Query(
        areas,
        f"""SELECT boroname, ntaname, count(DISTINCT station_id) AS selected_stations, CAST(sum(p) AS BIGINT) AS total_pickups,
            {r("avg(p)")} AS average_pickups_per_station, {r("sum(p) / sum(sum(p)) OVER ()")} AS pickup_share
            FROM (SELECT c_custkey AS station_id, nullif(r_name, 'ASIA') AS boroname, n_name AS ntaname, count(*) AS p
                  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
                  JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)
            WHERE boroname IS NOT NULL GROUP BY 1, 2""",
    ),
    "daily_join": Query(
        daily_join,
        with_ctes(
            "grid",
            "weather",
            tail=f"""SELECT d.*, {r("t")} AS mean_temperature_c, {r("a")} AS mean_apparent_temperature_c, {r("p")} AS total_precipitation_mm,
                {r("h")} AS mean_humidity_pct, {r("w")} AS mean_wind_speed_kmh
                FROM (SELECT CAST("timestamp" AS DATE) AS date, CAST(sum(pickups) AS BIGINT) AS total_pickups,
                             {r("avg(pickups)")} AS mean_hourly_pickups FROM grid GROUP BY 1) d
                JOIN (SELECT CAST("timestamp" AS DATE) AS date, avg(temperature_c) t, avg(apparent_temperature_c) a,
                             sum(precipitation_mm) p, avg(relative_humidity_pct) h, avg(wind_speed_kmh) w
                      FROM weather GROUP BY 1) x ON x.date = d.date
                WHERE d.date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'""",
        ),
    ),
    "hourly_join": Query(
        hourly_join,
        with_ctes(
            "grid",
            "weather",
            tail=f"""SELECT g."timestamp", CAST(sum(pickups) AS BIGINT) AS total_pickups, {r("any_value(precipitation_mm)")} AS precipitation_mm
                FROM grid g JOIN weather w ON w."timestamp" = g."timestamp"
                WHERE g."timestamp" BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-26 23:00:00' GROUP BY 1""",
        ),
    ),
    "daily_errors": Query(
        lambda spark, sf_dir: rounded(reports.errors_by_day_with_weather(materialize(frame_with_weather(spark, sf_dir), "errors"))),
        with_ctes(
            "errors",
            "weather",
            tail=f"""SELECT e.*, {r("t")} AS mean_temperature_c, {r("p")} AS total_precipitation_mm, precipitating_hours
                FROM (SELECT CAST("timestamp" AS DATE) AS date, {ERROR_COLUMNS} FROM errors GROUP BY 1) e
                JOIN (SELECT CAST("timestamp" AS DATE) AS date, avg(temperature_c) t, sum(precipitation_mm) p,
                             count(*) FILTER (WHERE precipitation_mm > 0) AS precipitating_hours
                      FROM weather GROUP BY 1) w ON w.date = e.date""",
        ),
    ),
    "hourly_errors": Query(
        lambda spark, sf_dir: rounded(reports.error_by(frame(spark, sf_dir), ["hour"])),
        with_ctes("errors", tail=f"SELECT hour, {ERROR_COLUMNS} FROM errors GROUP BY hour"),
    ),
    "station_errors": Query(
        lambda spark, sf_dir: rounded(station_errors(spark, sf_dir).orderBy(F.desc("mae"))),
        with_ctes("errors", tail=f"SELECT station_id, station_name, {ERROR_COLUMNS} FROM errors GROUP BY 1, 2"),
    ),
    "active_station_errors": Query(
        lambda spark, sf_dir: rounded(reports.active(station_errors(spark, sf_dir))),
        with_ctes("errors", tail=f"SELECT station_id, station_name, {ERROR_COLUMNS} FROM errors GROUP BY 1, 2 HAVING sum(pickups) > 0"),
    ),
    "largest_misses": Query(
        lambda spark, sf_dir: rounded(reports.largest_misses(frame_with_weather(spark, sf_dir))),
        with_ctes(
            "misses",
            tail=f"""SELECT "timestamp", station_id, station_name, pickups, {r("temperature_c")} AS temperature_c,
                {r("precipitation_mm")} AS precipitation_mm, is_precipitating, hour, prediction, CAST(error AS DOUBLE) AS error,
                CAST(absolute_error AS DOUBLE) AS absolute_error, CAST(squared_error AS DOUBLE) AS squared_error FROM misses""",
        ),
    ),
    "misses_by_direction": Query(
        lambda spark, sf_dir: rounded(reports.misses_by_direction(misses(spark, sf_dir))),
        with_ctes(
            "misses",
            tail=f"""SELECT CASE WHEN error > 0 THEN 'overprediction' ELSE 'underprediction' END AS direction, count(*) AS "count",
                {r("avg(absolute_error)")} AS mean_absolute_error, CAST(max(absolute_error) AS DOUBLE) AS max_absolute_error
                FROM misses GROUP BY 1""",
        ),
    ),
    "misses_by_hour": Query(
        lambda spark, sf_dir: reports.misses_by_hour(misses(spark, sf_dir)),
        with_ctes("misses", tail="SELECT hour, count(*) AS count_in_top FROM misses GROUP BY 1"),
    ),
    "inactive_monthly": Query(
        inactive_monthly,
        with_ctes(
            "by_name",
            "all_hours",
            tail=f""", pairs AS (SELECT station_id || '-' || station_name AS station_id, "timestamp", pickups FROM by_name),
                grid_pairs AS (SELECT h."timestamp", s.station_id, coalesce(p.pickups, 0) AS pickups FROM all_hours h
                    CROSS JOIN (SELECT DISTINCT station_id FROM pairs) s LEFT JOIN pairs p ON p."timestamp" = h."timestamp" AND p.station_id = s.station_id)
                SELECT station_id, 'S' || station_id AS station_name, strftime("timestamp", '%Y-%m') AS year_month,
                CAST(sum(pickups) AS BIGINT) AS total_pickups, count(*) FILTER (WHERE pickups > 0) AS active_hours,
                count(pickups) AS total_hours FROM grid_pairs
                WHERE station_id IN (SELECT station_id FROM grid_pairs WHERE "timestamp" >= TIMESTAMP '{base.TEST_START} 00:00:00' AND "timestamp" < TIMESTAMP '{base.TEST_END} 00:00:00'
                                     GROUP BY 1 HAVING sum(pickups) = 0) GROUP BY 1, 2, 3""",
        ),
    ),
    "drift_errors": Query(
        drift_errors,
        with_ctes(
            "test",
            tail="""SELECT "timestamp", station_id, pickups, 2 * lag_24 - lag_168 AS drift, prediction, prediction - pickups AS error, abs(prediction - pickups) AS absolute_error,
                (prediction - pickups) * (prediction - pickups) AS squared_error
                FROM (SELECT *, greatest(CAST(2 * lag_24 - lag_168 AS DOUBLE), 0.0) AS prediction FROM test)""",
        ),
    ),
    "baseline_errors_by_day": Query(
        lambda spark, sf_dir: rounded(
            reports.mean_errors_by(test_rows(spark, sf_dir).withColumn("date", F.to_date("timestamp")), ["date"], BASELINES)
        ),
        with_ctes("test", tail=f"""SELECT CAST("timestamp" AS DATE) AS date, {MEAN_ERROR_COLUMNS} FROM test GROUP BY 1"""),
    ),
    "baseline_errors_by_entity": Query(
        lambda spark, sf_dir: rounded(
            reports.mean_errors_by(test_rows(spark, sf_dir), ["station_id", "station_name"], BASELINES)
            .withColumn("last_week_improvement", F.col("yesterday_mae") - F.col("last_week_mae"))
            .withColumn("last_week_is", gain_label(F.col("last_week_improvement")))
            .orderBy(F.desc("last_week_mae"))
        ),
        with_ctes(
            "test",
            tail=f"""SELECT station_id, station_name, {MEAN_ERROR_COLUMNS},
                {r("avg(abs(lag_24 - pickups)) - avg(abs(lag_168 - pickups))")} AS last_week_improvement,
                CASE WHEN avg(abs(lag_24 - pickups)) - avg(abs(lag_168 - pickups)) > 0 THEN 'better' ELSE 'worse' END AS last_week_is
                FROM test GROUP BY 1, 2""",
        ),
    ),
    "top_entities_by_error": Query(
        worst_rounded,
        with_ctes(
            "station_errors",
            tail=f"""SELECT station_id, {r("mae", 2)} AS mae FROM station_errors WHERE actual_pickups > 0
                     ORDER BY station_errors.mae DESC, station_id LIMIT 10""",
        ),
    ),
    "one_entity_series": Query(
        one_entity,
        with_ctes(
            "test",
            tail="""SELECT "timestamp", station_id, pickups, lag_24, lag_168, round_even(rolling_mean_168, 2) AS rolling_mean
                    FROM test WHERE station_name = 'click'""",
        ),
    ),
    "table_preview": Query(
        preview,
        with_ctes("test", tail="""SELECT "timestamp", station_id, pickups, lag_24, lag_168 FROM test ORDER BY station_id, "timestamp" LIMIT 175"""),
    ),
}
