"""Counts, names, selection, grid, quality reports and joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.time import first_hour_of_month, floor_hour, last_hour_of_month, month_label, next_month_start
from hourgrid.operators.counts import hourly_counts, sum_by
from hourgrid.operators.joins import add_weather, join_checked, join_counted, keep_listed, lookup
from hourgrid.operators.quality import coverage_gaps, density_gaps, duplicate_keys, join_report, null_counts
from hourgrid.plans.dataset import build_dataset, named_hourly, select_stations, station_names
from hourgrid.plans.features import add_calendar_features
from hourgrid.session import materialize
from queries import base
from queries.base import Query, r, rounded, table, with_ctes


def hourly_counts_query(spark, sf_dir) -> DataFrame:
    """Trips whose name is missing are dropped; one event type plays the missing name."""
    named = base.trips(spark, sf_dir).withColumn("start_station_name", F.nullif("start_station_name", F.lit("signup")))
    return hourly_counts(named)


def month_bounds(spark, sf_dir) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").groupBy(first_hour_of_month(ts).alias("first_hour")).agg(
        F.max(last_hour_of_month(ts)).alias("last_hour"),
        F.max(next_month_start(ts)).alias("next_month"),
        F.max(month_label(ts)).alias("year_month"),
        F.count("*").alias("trips"),
    )


def top_stations(spark, sf_dir) -> DataFrame:
    return select_stations(base.hourly_by_station(spark, sf_dir), base.CUTOFF, base.TOP_N)


def coverage(spark, sf_dir) -> DataFrame:
    """The expected range starts a day late and ends with the month: both kinds of gap occur."""
    hourly = hourly_counts(base.trips(spark, sf_dir), keys=[])
    return coverage_gaps(hourly, "timestamp", datetime(2024, 1, 2), datetime(2024, 1, 31, 23))


def duplicates(spark, sf_dir) -> DataFrame:
    daily = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return duplicate_keys(daily, ["user_id", "event_type", "day"])


def nulls(spark, sf_dir) -> DataFrame:
    holed = table(spark, sf_dir, "events").select(
        "event_id",
        F.nullif("event_type", F.lit("view")).alias("event_type"),
        F.when(F.col("value") > 5, F.col("value")).alias("value"),
        F.when(F.hour("ts") != 3, F.col("ts")).alias("ts"),
    )
    return null_counts(holed)


def join_contract(spark, sf_dir) -> DataFrame:
    """Events to nations by number: users beyond the nations have no partner."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("int").alias("n_nationkey"))
    joined = join_checked(events, table(spark, sf_dir, "nation"), "n_nationkey", "left", "many_to_one")
    return join_report(events, joined, "n_name")


def join_counted_once(spark, sf_dir) -> DataFrame:
    """Lines to orders of one status, counted while the joined table is written."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "F").select("o_orderkey", "o_custkey")
    joined, counts = join_counted(lines, orders, "o_orderkey", "o_custkey")
    written = materialize(joined, "joined")
    counts.require_unchanged("lines to orders")
    found = {name: F.lit(n).alias(name) for name, n in counts.get().items()}
    return written.agg(*found.values(), F.sum(F.when(F.col("o_custkey").isNotNull(), F.col("l_quantity"))).alias("matched_quantity"))


def exogenous_join(spark, sf_dir) -> DataFrame:
    return rounded(add_weather(base.hourly_by_station(spark, sf_dir), base.weather(spark, sf_dir)))


def calendar_features(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("timestamp"))
    return rounded(add_calendar_features(events))


def one_to_one(spark, sf_dir) -> DataFrame:
    """Station totals and a station attribute, each unique on the station."""
    totals = base.station_totals(spark, sf_dir)
    attribute = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("station_id")).agg(
        F.avg("value").alias("latitude")
    )
    return rounded(join_checked(totals, attribute, "station_id", "left", "one_to_one"))


def busiest_rows(spark, sf_dir) -> DataFrame:
    """Hourly rows of the selected stations, with a name only where the lookup has one."""
    hourly = named_hourly(base.trips(spark, sf_dir))
    top = select_stations(hourly, base.CUTOFF, base.TOP_N)
    clicks = station_names(hourly).where(F.col("station_name") == "click")
    chosen = keep_listed(sum_by(hourly, ["timestamp", "station_id"]), top, "station_id")
    return lookup(chosen, clicks, "station_id")


def typed_lines(spark, sf_dir) -> DataFrame:
    """Text round trip of the times: strict and lenient parsing, renames, suffix tests, casts."""
    text = table(spark, sf_dir, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"),
        F.concat(F.upper("event_type"), F.when(F.col("value") > 20, ".CSV").otherwise(".txt")).alias("member"),
        F.when(F.col("value") > 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("not a time").alias("maybe"),
        F.lit("helper").alias("helper"),
    )
    typed = text.withColumns(
        {
            "parsed": F.to_timestamp_ntz("time"),
            "lenient": F.expr("try_cast(maybe as timestamp_ntz)"),
            "is_csv": F.lower("member").like("%.csv"),
            "prefix": F.substring("member", 1, 4),
        }
    )
    return typed.drop("helper", "time", "maybe").withColumnsRenamed({"event_id": "trip_id", "parsed": "timestamp"})


QUERIES = {
    "hourly_counts": Query(
        hourly_counts_query,
        """SELECT date_trunc('hour', ts) AS "timestamp", CAST(user_id AS VARCHAR) AS start_station_id,
                  event_type AS start_station_name, count(*) AS pickups
           FROM events WHERE nullif(event_type, 'signup') IS NOT NULL GROUP BY ALL""",
    ),
    "month_bounds": Query(
        month_bounds,
        """SELECT date_trunc('month', ts)::TIMESTAMP AS first_hour,
                  max(last_day(ts)::TIMESTAMP + INTERVAL 23 HOUR) AS last_hour,
                  max(date_trunc('month', ts)::TIMESTAMP + INTERVAL 1 MONTH) AS next_month,
                  max(strftime(ts, '%Y-%m')) AS year_month, count(*) AS trips
           FROM events GROUP BY 1""",
    ),
    "canonical_name": Query(
        lambda spark, sf_dir: station_names(base.hourly_by_name(spark, sf_dir)),
        with_ctes("names", tail="SELECT station_id, station_name FROM names"),
    ),
    "top_stations": Query(top_stations, with_ctes("top", tail="SELECT station_id, total FROM top")),
    "dense_grid": Query(
        lambda spark, sf_dir: build_dataset(base.trips(spark, sf_dir), base.CUTOFF, base.TOP_N),
        with_ctes("grid", tail="SELECT * FROM grid"),
    ),
    "dense_grid_all": Query(base.grid_of_all, with_ctes("grid_all", tail="SELECT * FROM grid_all")),
    "coverage_gaps": Query(
        coverage,
        """WITH expected AS (
             SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR)) AS "timestamp"),
           actual AS (SELECT DISTINCT date_trunc('hour', ts) AS "timestamp" FROM events)
           SELECT "timestamp", 'missing' AS problem FROM (SELECT * FROM expected EXCEPT SELECT * FROM actual)
           UNION ALL
           SELECT "timestamp", 'unexpected' FROM (SELECT * FROM actual EXCEPT SELECT * FROM expected)""",
    ),
    "density_gaps": Query(
        # hours of single trips, so that stations have repeated hours beside missing ones
        lambda spark, sf_dir: density_gaps(
            base.trips(spark, sf_dir).select(F.col("start_station_id").alias("station_id"), floor_hour("started_at").alias("timestamp")), "station_id"
        ),
        """SELECT CAST(user_id AS VARCHAR) AS station_id, count(*) AS "rows", count(DISTINCT date_trunc('hour', ts)) AS present,
                  date_diff('hour', date_trunc('hour', min(ts)), date_trunc('hour', max(ts))) + 1 AS hours FROM events GROUP BY 1
           HAVING "rows" <> hours OR present <> hours""",
    ),
    "duplicate_keys": Query(
        duplicates,
        """SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events
           GROUP BY ALL HAVING count(*) > 1""",
    ),
    "null_counts": Query(
        nulls,
        """SELECT 'event_id' AS "column", count(*) FILTER (WHERE event_id IS NULL) AS nulls FROM events UNION ALL
           SELECT 'event_type', count(*) FILTER (WHERE event_type = 'view') FROM events UNION ALL
           SELECT 'value', count(*) FILTER (WHERE NOT value > 5) FROM events UNION ALL
           SELECT 'ts', count(*) FILTER (WHERE hour(ts) = 3) FROM events""",
    ),
    "join_contract": Query(
        join_contract,
        """SELECT (SELECT count(*) FROM events) AS rows_before, count(*) AS rows_after,
                  count(*) FILTER (WHERE n_name IS NULL) AS unmatched
           FROM events LEFT JOIN nation ON n_nationkey = user_id""",
    ),
    "join_counted": Query(
        join_counted_once,
        """SELECT count(*) AS rows_before, count(*) AS rows_after, count(*) FILTER (o_custkey IS NULL) AS unmatched,
                  sum(l_quantity) FILTER (o_custkey IS NOT NULL) AS matched_quantity
           FROM lineitem LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F') ON o_orderkey = l_orderkey""",
    ),
    "exogenous_join": Query(
        exogenous_join,
        with_ctes(
            "by_station",
            "weather",
            tail=f"""SELECT b."timestamp", b.station_id, b.pickups, {r("temperature_c")} AS temperature_c,
                {r("apparent_temperature_c")} AS apparent_temperature_c, {r("relative_humidity_pct")} AS relative_humidity_pct,
                {r("precipitation_mm")} AS precipitation_mm, {r("wind_speed_kmh")} AS wind_speed_kmh, weather_code,
                CAST(precipitation_mm > 0 AS INTEGER) AS is_precipitating
                FROM by_station b LEFT JOIN weather w ON w."timestamp" = b."timestamp\"""",
        ),
    ),
    "calendar_features": Query(
        calendar_features,
        f"""SELECT event_id, "timestamp", hour, day_of_week, month, is_weekend, {r("hour_sin")} AS hour_sin,
                   {r("hour_cos")} AS hour_cos, {r("day_of_week_sin")} AS day_of_week_sin, {r("day_of_week_cos")} AS day_of_week_cos
            FROM (SELECT event_id, "timestamp", {base.CALENDAR_SQL}
                  FROM (SELECT event_id, ts AS "timestamp" FROM events))""",
    ),
    "one_to_one_join": Query(
        one_to_one,
        f"""SELECT CAST(user_id AS VARCHAR) AS station_id, count(*) AS pickups, {r("avg(value)")} AS latitude
            FROM events GROUP BY 1""",
    ),
    "semi_join_and_lookup": Query(
        busiest_rows,
        with_ctes(
            "top",
            "names",
            tail="""SELECT b."timestamp", b.station_id, b.pickups, n.station_name FROM by_station b
                    LEFT JOIN (SELECT * FROM names WHERE station_name = 'click') n ON n.station_id = b.station_id
                    WHERE b.station_id IN (SELECT station_id FROM top)""",
        ),
    ),
    "parsed_renamed": Query(
        typed_lines,
        """SELECT event_id AS trip_id, date_trunc('minute', ts) AS "timestamp",
                  upper(event_type) || CASE WHEN value > 20 THEN '.CSV' ELSE '.txt' END AS member,
                  CASE WHEN value > 3 THEN date_trunc('second', ts) END AS lenient,
                  value > 20 AS is_csv, substr(upper(event_type) || '.txt', 1, 4) AS prefix
           FROM events""",
    ),
}
