"""Sources and sinks: the given tables are written in the landed formats and read back by the library."""

from __future__ import annotations

import zipfile
from contextlib import ExitStack

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.operators.counts import hourly_counts
from hourgrid.operators.quality import column_report
from hourgrid.operators.spatial import points_in_polygons
from hourgrid.operators.stations import station_metadata
from hourgrid.schemas import HOURLY_PICKUPS, OBSERVED_WEATHER_NAMES, TRIP_COLUMNS
from hourgrid.session import materialize, new_path
from hourgrid.sources.archives import open_filesystem, ship_with_tasks
from hourgrid.sources.geojson import read_geojson
from hourgrid.sources.tables import missing_months, read_monthly, read_months, rewrite_months, write_monthly
from hourgrid.sources.trips import read_station_points, read_trips, rejected_trips
from hourgrid.sources.weather import hourly_rows, read_responses, require_clean, require_variables, unit_counts
from queries import base
from queries.base import Query, r, rounded, table, with_ctes


def archive_rows(spark, sf_dir) -> DataFrame:
    """Events as trip lines. A trip belongs to the archive of the month the day before it lies in, so
    those of the first day of a month sit in the wrong archive and must not be counted."""
    return table(spark, sf_dir, "events").select(
        F.date_format(F.col("ts") - F.expr("interval 1 day"), "yyyyMM").alias("archive"),
        F.col("event_id").cast("string").alias("ride_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("started_at"),
        F.concat("user_id", F.lit(".10")).alias("start_station_id"),
        F.concat(F.lit('St "'), "event_type", F.lit('", NY')).alias("start_station_name"),
        F.when(F.col("event_type") != "view", F.col("value")).cast("string").alias("start_lat"),
        (-F.col("value")).cast("string").alias("start_lng"),
    )


def write_archives(rows: DataFrame, folder: str, zipped: bool = True) -> None:
    """Hash parts of every month, each streamed batch by batch into the one member of its own archive, or into a file.

    It appears under its name only when it is complete, and a retried task writes the same one.
    """

    def write(batches):
        filesystem, path = open_filesystem(folder)
        filesystem.create_dir(path, recursive=True)
        task = TaskContext.get()
        written = []
        with ExitStack() as stack:
            month, lines = None, None
            for batch in batches:
                for name in pc.unique(batch["archive"]).to_pylist():
                    if name != month:
                        stack.close()
                        month = name
                        final = f"{path}/{month}-part{task.partitionId():05d}-tripdata.{'zip' if zipped else 'csv'}"
                        draft = f"{final}.{task.taskAttemptId()}"
                        stack.push(lambda failed, *_: None if failed else filesystem.move(draft, final))
                        out = stack.enter_context(filesystem.open_output_stream(draft))
                        if zipped:
                            archive = stack.enter_context(zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED))
                            out = stack.enter_context(archive.open("TRIPS.CSV", "w", force_zip64=True))
                        lines = stack.enter_context(pyarrow.csv.CSVWriter(out, batch.schema))
                        written.append(final)
                    lines.write(batch.filter(pc.equal(batch["archive"], name)))
        yield pa.RecordBatch.from_pydict({"name": pa.array(written, pa.string())})

    ship_with_tasks()
    parts = rows.sparkSession.sparkContext.defaultParallelism
    placed = rows.repartition("archive", F.pmod(F.xxhash64("ride_id"), F.lit(parts))).sortWithinPartitions("archive")
    placed.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def zip_trips(spark, sf_dir) -> DataFrame:
    folder = new_path(spark, "archives")
    write_archives(archive_rows(spark, sf_dir), folder)
    return hourly_counts(read_trips(spark, f"{folder}/20????-*tripdata.zip"))


def csv_hourly(spark, sf_dir) -> DataFrame:
    """The lines as CSV files; those of errors have a time that cannot be read, and those of views none."""
    folder = new_path(spark, "csv")
    write_archives(_with_bad_times(archive_rows(spark, sf_dir)), folder, zipped=False)
    return hourly_counts(read_trips(spark, folder, zipped=False))


def rejected_lines(spark, sf_dir) -> DataFrame:
    """The lines that are no trips, by file month and reason."""
    folder = new_path(spark, "csv")
    write_archives(_with_bad_times(archive_rows(spark, sf_dir)), folder, zipped=False)
    rejected = rejected_trips(spark, folder, zipped=False)
    return rejected.groupBy(F.substring("archive", 1, 6).alias("month"), "reason").agg(
        F.count("*").alias("lines"), F.count("started_at").alias("with_time"), F.count_distinct("start_station_id").alias("stations")
    )


def _with_bad_times(rows: DataFrame) -> DataFrame:
    kind = F.col("start_station_name")
    text = F.when(kind.contains("error"), F.concat(F.lit("at "), "started_at")).when(~kind.contains("view"), F.col("started_at"))
    return rows.withColumn("started_at", text)


def zip_station_points(spark, sf_dir) -> DataFrame:
    folder = new_path(spark, "archives")
    write_archives(archive_rows(spark, sf_dir), folder)
    return rounded(station_metadata(read_station_points(spark, folder)))


def csv_trips(spark, sf_dir) -> DataFrame:
    """The same lines as extracted CSV files: one directory per month, files named after it."""
    rows = archive_rows(spark, sf_dir).drop("archive")
    folder = new_path(spark, "csv")
    rows.write.option("header", True).option("escape", '"').csv(folder)
    points = read_station_points(spark, folder, zipped=False)
    return rounded(points.groupBy("start_station_id").agg(
        F.count("*").alias("trips"), F.count("start_lat").alias("located"), F.sum("start_lng").alias("lng_sum"),
        F.count_distinct("start_station_name").alias("names"),
    ))


def json_arrays(spark, sf_dir) -> DataFrame:
    """One response per day, each with at most 24 hours, as documents of parallel arrays."""
    variables = {column: variable for variable, column in OBSERVED_WEATHER_NAMES.items()}
    hourly = base.weather(spark, sf_dir).withColumn("time", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm"))
    fields = [F.col("time"), *[F.col(c).alias(variables[c]) for c in variables if c != "timestamp"]]
    per_day = hourly.groupBy(F.to_date("timestamp").alias("day")).agg(F.collect_list(F.struct(*fields)).alias("rows"))
    arrays = F.struct(*[F.col(f"rows.{v}").alias(v) for v in OBSERVED_WEATHER_NAMES])
    document = F.struct(arrays.alias("hourly"), F.create_map(F.lit("precipitation"), F.lit("mm")).alias("hourly_units"))
    path = new_path(spark, "responses")
    per_day.select(F.to_json(document)).write.text(path)
    responses = read_responses(spark, path, OBSERVED_WEATHER_NAMES, one_per_line=True)
    require_variables(responses, OBSERVED_WEATHER_NAMES)
    parsed = hourly_rows(responses, OBSERVED_WEATHER_NAMES)
    require_clean(parsed)
    return rounded(parsed)


def label_points(spark, sf_dir) -> DataFrame:
    """The first two numbers of every vector as a point; null where the third is large."""
    coordinate = [F.col("embedding")[i].cast("double") for i in range(3)]
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("station_id"),
        F.when(coordinate[2] < 0.2, coordinate[0]).alias("longitude"),
        coordinate[1].alias("latitude"),
    )


def label_polygons(spark, sf_dir) -> DataFrame:
    """Per label a box around its vectors' mean with a box-shaped hole; odd labels add a distant triangle."""
    x, y = F.avg(F.col("embedding")[0].cast("double")), F.avg(F.col("embedding")[1].cast("double"))
    centres = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))

    def ring(*corners):
        return F.array(*[F.array(F.col("x") + dx, F.col("y") + dy) for dx, dy in [*corners, corners[0]]])

    def box(size):
        return ring((-size, -size), (size, -size), (size, size), (-size, size))

    holed = F.array(box(0.125), box(0.03125))
    triangle = F.array(ring((0.25, 0.25), (0.5, 0.25), (0.25, 0.5)))
    return centres.select(
        F.concat(F.lit("B"), F.col("label") % 2).alias("boroname"),
        F.concat(F.lit("N"), "label").alias("ntaname"),
        F.when(F.col("label") % 2 == 1, F.array(holed, triangle)).otherwise(F.array(holed)).alias("geometry"),
    )


def spatial_join(spark, sf_dir) -> DataFrame:
    polygons = label_polygons(spark, sf_dir)
    return rounded(points_in_polygons(label_points(spark, sf_dir), polygons, ["boroname", "ntaname"], cell=0.1))


def geojson_join(spark, sf_dir) -> DataFrame:
    """The same polygons landed as a feature collection, joined, and counted per area."""
    polygons = label_polygons(spark, sf_dir)
    parts = F.size("geometry")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct("boroname", "ntaname").alias("properties"),
        F.struct(
            F.when(parts == 1, "Polygon").otherwise("MultiPolygon").alias("type"),
            F.when(parts == 1, F.to_json(F.col("geometry")[0])).otherwise(F.to_json("geometry")).alias("coordinates"),
        ).alias("geometry"),
    )
    document = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")))
    # The coordinates are JSON already: unwrap the text they became inside the document.
    unwrapped = F.regexp_replace(document, r'"coordinates":"([^"]*)"', r'"coordinates":$1')
    path = new_path(spark, "polygons")
    polygons.select(unwrapped).write.text(path)
    landed = read_geojson(spark, path, ["boroname", "ntaname"], one_per_line=True)
    joined = points_in_polygons(label_points(spark, sf_dir), landed, ["boroname", "ntaname"], cell=0.1)
    return joined.groupBy("boroname", "ntaname").agg(F.count("*").alias("points"))


def label_centroids(spark, sf_dir) -> DataFrame:
    """Vectors as trips: label is the station, parity of the vector its name."""
    points = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("start_station_id"),
        F.concat(F.lit("name "), F.col("vec_id") % 3).alias("start_station_name"),
        F.col("embedding")[0].cast("double").alias("start_lat"),
        F.col("embedding")[1].cast("double").alias("start_lng"),
    )
    return rounded(station_metadata(points))


def hourly_roundtrip(spark, sf_dir) -> DataFrame:
    path = new_path(spark, "hourly_fact")
    write_monthly(base.grid(spark, sf_dir), path)
    found = read_monthly(spark, path)
    assert found.schema == HOURLY_PICKUPS
    return found


def orders_by_month(spark, sf_dir, status: str | None = None) -> DataFrame:
    """Orders as an hourly fact: per day and status how many there are, with their priority as the name."""
    orders = table(spark, sf_dir, "orders")
    chosen = orders if status is None else orders.where((F.col("o_orderstatus") == status) & (F.col("o_totalprice") > 490_000))
    keys = [F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"), F.col("o_orderstatus").alias("station_id"), F.col("o_orderpriority").alias("station_name")]
    return chosen.groupBy(*keys).agg(F.count("*").cast("int").alias("pickups"))


REWRITTEN = "1996-02"


def month_rewrite(spark, sf_dir) -> DataFrame:
    """One month is written again with doubled counts; the others stay as they were."""
    path = new_path(spark, "orders_fact")
    write_monthly(orders_by_month(spark, sf_dir), path)
    again = read_months(spark, path, REWRITTEN, REWRITTEN).withColumn("pickups", F.col("pickups") * 2)
    rewrite_months(materialize(again, "again"), path)
    return read_monthly(spark, path)


def months_without_rows(spark, sf_dir) -> DataFrame:
    path = new_path(spark, "orders_fact")
    write_monthly(orders_by_month(spark, sf_dir, "P"), path)
    return missing_months(spark, path)


def required_columns(spark, sf_dir) -> DataFrame:
    """The columns of a trip in a table that lacks one of them and has gaps in another."""
    trips = table(spark, sf_dir, "events").select(
        F.col("ts").alias("started_at"), F.nullif(F.col("event_type"), F.lit("error")).alias("start_station_id"), "value"
    )
    return column_report(trips, TRIP_COLUMNS).drop("type")


def weather_units(spark, sf_dir) -> DataFrame:
    """One response a day; dry days give their precipitation in another unit."""
    daily = base.weather(spark, sf_dir).groupBy(F.to_date("timestamp").alias("day")).agg(F.sum("precipitation_mm").alias("rain"), F.collect_list("temperature_c").alias("temperature_2m"))
    said = F.create_map(F.lit("temperature_2m"), F.lit("C"), F.lit("precipitation"), F.when(F.col("rain") > daily.agg(F.avg("rain")).scalar(), "mm").otherwise("inch"))
    path = new_path(spark, "responses")
    daily.select(F.to_json(F.struct(F.struct("temperature_2m").alias("hourly"), said.alias("hourly_units")))).write.text(path)
    return unit_counts(read_responses(spark, path, OBSERVED_WEATHER_NAMES, one_per_line=True))


POLYGON_CTES = """
WITH points AS (
  SELECT vec_id AS station_id, CASE WHEN embedding[3]::DOUBLE < 0.2 THEN embedding[1]::DOUBLE END AS longitude,
         embedding[2]::DOUBLE AS latitude FROM embeddings),
centres AS (
  SELECT label, round(avg(embedding[1]::DOUBLE), 2) AS x, round(avg(embedding[2]::DOUBLE), 2) AS y FROM embeddings GROUP BY label),
corners(shape, i, dx, dy) AS (VALUES
  ('o', 1, -0.125, -0.125), ('o', 2, 0.125, -0.125), ('o', 3, 0.125, 0.125), ('o', 4, -0.125, 0.125), ('o', 5, -0.125, -0.125),
  ('h', 1, -0.03125, -0.03125), ('h', 2, 0.03125, -0.03125), ('h', 3, 0.03125, 0.03125), ('h', 4, -0.03125, 0.03125), ('h', 5, -0.03125, -0.03125),
  ('t', 1, 0.25, 0.25), ('t', 2, 0.5, 0.25), ('t', 3, 0.25, 0.5), ('t', 4, 0.25, 0.25)),
vertices AS (
  SELECT label, shape, i, x + dx::DOUBLE AS x, y + dy::DOUBLE AS y FROM centres CROSS JOIN corners
  WHERE shape <> 't' OR label % 2 = 1),
edges AS (
  SELECT a.label, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM vertices a
  JOIN vertices b ON b.label = a.label AND b.shape = a.shape AND b.i = a.i + 1),
hits AS (
  SELECT p.station_id, e.label FROM points p JOIN edges e ON p.longitude IS NOT NULL
  GROUP BY 1, 2
  HAVING count(*) FILTER (WHERE (y1 > latitude) <> (y2 > latitude)
                          AND longitude < x1 + (latitude - y1) * (x2 - x1) / nullif(y2 - y1, 0)) % 2 = 1
     AND count(*) FILTER (WHERE (x2 - x1) * (latitude - y1) - (y2 - y1) * (longitude - x1) = 0
                          AND longitude BETWEEN least(x1, x2) AND greatest(x1, x2)
                          AND latitude BETWEEN least(y1, y2) AND greatest(y1, y2)) = 0)
"""

QUERIES = {
    "zip_trips": Query(
        zip_trips,
        """SELECT date_trunc('hour', ts) AS "timestamp", user_id || '.10' AS start_station_id,
                  'St "' || event_type || '", NY' AS start_station_name, count(*) AS pickups FROM events
           WHERE date_trunc('month', ts) = date_trunc('month', ts - INTERVAL 1 DAY) GROUP BY ALL""",
    ),
    "csv_hourly": Query(
        csv_hourly,
        """SELECT date_trunc('hour', ts) AS "timestamp", user_id || '.10' AS start_station_id,
                  'St "' || event_type || '", NY' AS start_station_name, count(*) AS pickups FROM events
           WHERE date_trunc('month', ts) = date_trunc('month', ts - INTERVAL 1 DAY) AND event_type NOT IN ('error', 'view') GROUP BY ALL""",
    ),
    "rejected_lines": Query(
        rejected_lines,
        """SELECT strftime(ts - INTERVAL 1 DAY, '%Y%m') AS month,
                  CASE event_type WHEN 'error' THEN 'time cannot be read' WHEN 'view' THEN 'incomplete' ELSE 'another month' END AS reason,
                  count(*) AS lines, count(*) FILTER (WHERE event_type <> 'view') AS with_time, count(DISTINCT user_id) AS stations FROM events
           WHERE event_type IN ('error', 'view') OR date_trunc('month', ts) <> date_trunc('month', ts - INTERVAL 1 DAY) GROUP BY ALL""",
    ),
    "zip_station_points": Query(
        zip_station_points,
        f"""SELECT station_id, station_name, {r("lat")} AS latitude, {r("lng")} AS longitude FROM (
              SELECT user_id || '.10' AS station_id, 'St "' || event_type || '", NY' AS station_name,
                     avg(value) AS lat, avg(-value) AS lng,
                     row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn
              FROM events WHERE event_type <> 'view' GROUP BY user_id, event_type) WHERE rn = 1""",
    ),
    "csv_trips": Query(
        csv_trips,
        f"""SELECT user_id || '.10' AS start_station_id, count(*) AS trips, count(*) FILTER (WHERE event_type <> 'view') AS located,
                   {r("sum(-value)")} AS lng_sum, count(DISTINCT event_type) AS names FROM events GROUP BY 1""",
    ),
    "json_arrays": Query(
        json_arrays,
        with_ctes(
            "weather",
            tail=f"""SELECT "timestamp", {r("temperature_c")} AS temperature_c, {r("apparent_temperature_c")} AS apparent_temperature_c,
                {r("relative_humidity_pct")} AS relative_humidity_pct, {r("precipitation_mm")} AS precipitation_mm,
                {r("wind_speed_kmh")} AS wind_speed_kmh, weather_code FROM weather""",
        ),
    ),
    "points_in_polygons": Query(
        spatial_join,
        POLYGON_CTES
        + f"""SELECT p.station_id, {r("longitude")} AS longitude, {r("latitude")} AS latitude,
                'B' || label % 2 AS boroname, 'N' || label AS ntaname
                FROM points p LEFT JOIN hits h ON h.station_id = p.station_id""",
    ),
    "geojson_polygons": Query(
        geojson_join,
        POLYGON_CTES
        + """SELECT 'B' || label % 2 AS boroname, 'N' || label AS ntaname, count(*) AS points
             FROM points p LEFT JOIN hits h ON h.station_id = p.station_id GROUP BY 1, 2""",
    ),
    "station_centroid": Query(
        label_centroids,
        f"""SELECT station_id, station_name, {r("lat")} AS latitude, {r("lng")} AS longitude FROM (
              SELECT label::VARCHAR AS station_id, 'name ' || vec_id % 3 AS station_name, avg(embedding[1]::DOUBLE) AS lat,
                     avg(embedding[2]::DOUBLE) AS lng,
                     row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, 'name ' || vec_id % 3) AS rn
              FROM embeddings GROUP BY label, vec_id % 3) WHERE rn = 1""",
    ),
    "month_rewrite": Query(
        month_rewrite,
        f"""SELECT o_orderdate::TIMESTAMP AS "timestamp", o_orderstatus AS station_id, o_orderpriority AS station_name,
            CAST(count(*) * CASE strftime(o_orderdate, '%Y-%m') WHEN '{REWRITTEN}' THEN 2 ELSE 1 END AS INTEGER) AS pickups FROM orders GROUP BY o_orderdate, 2, 3""",
    ),
    "missing_months": Query(
        months_without_rows,
        """WITH found AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 490000)
           SELECT strftime(x, '%Y-%m') AS month_label FROM (SELECT unnest(generate_series(min(m)::TIMESTAMP, max(m)::TIMESTAMP, INTERVAL 1 MONTH)) AS x FROM found) WHERE x::DATE NOT IN (SELECT m FROM found)""",
    ),
    "required_columns": Query(
        required_columns,
        """SELECT 'started_at' AS "column", true AS present, count(*) FILTER (ts IS NULL) AS nulls FROM events
           UNION ALL SELECT 'start_station_id', true, count(*) FILTER (event_type = 'error') FROM events
           UNION ALL SELECT 'start_station_name', false, NULL""",
    ),
    "weather_units": Query(
        weather_units,
        with_ctes(
            "weather",
            tail=""", daily AS (SELECT CAST("timestamp" AS DATE) AS day, sum(precipitation_mm) AS rain FROM weather GROUP BY 1)
                SELECT 'precipitation' AS variable, CASE WHEN rain > (SELECT avg(rain) FROM daily) THEN 'mm' ELSE 'inch' END AS unit, count(*) AS documents FROM daily GROUP BY 2
                UNION ALL SELECT 'temperature_2m', 'C', count(*) FROM daily""",
        ),
    ),
    "hourly_fact_roundtrip": Query(hourly_roundtrip, with_ctes("grid", tail="SELECT * FROM grid")),
}
