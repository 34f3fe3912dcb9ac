import json
import math
import zipfile
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid import jobs
from hourgrid.operators.quality import DataQualityError
from hourgrid.operators.spatial import points_in_polygons, polygon_cells
from hourgrid.operators.stations import station_metadata
from hourgrid.plans.dataset import build_dataset
from hourgrid.schemas import DAY_AHEAD_WEATHER_NAMES, OBSERVED_WEATHER_NAMES
from hourgrid.sources.archives import list_archives
from hourgrid.sources.geojson import read_geojson
from hourgrid.sources.tables import read_months, require_input, write_monthly
from hourgrid.sources.trips import INCOMPLETE, OTHER_MONTH, UNREADABLE, read_station_points, read_trips, rejected_trips
from hourgrid.sources.weather import hourly_rows, read_responses, read_weather, units
from tests.helpers import hours

SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]
ISLAND = [[10.0, 10.0], [12.0, 10.0], [11.0, 12.0], [10.0, 10.0]]
OVERLAP = [[3.0, 3.0], [5.0, 3.0], [5.0, 5.0], [3.0, 5.0], [3.0, 3.0]]

CASES = [
    ("inside", 0.5, 0.5, ["A"]),
    ("hole", 1.5, 1.5, [None]),
    ("outer edge left", 0.0, 2.0, [None]),
    ("outer edge right", 4.0, 2.0, [None]),
    ("vertex", 4.0, 4.0, ["B"]),
    ("hole edge", 1.0, 1.5, [None]),
    ("outside", -1.0, 2.0, [None]),
    ("beside the vertices' height", 5.5, 4.0, [None]),
    ("second part", 11.0, 11.0, ["A"]),
    ("two polygons", 3.5, 3.5, ["A", "B"]),
    ("no coordinate", None, 1.0, [None]),
]


def collection():
    def feature(name, kind, coordinates):
        return {"type": "Feature", "properties": {"boroname": "X", "ntaname": name, "other": 1}, "geometry": {"type": kind, "coordinates": coordinates}}

    return {"type": "FeatureCollection", "features": [feature("A", "MultiPolygon", [[SQUARE, HOLE], [ISLAND]]), feature("B", "Polygon", [OVERLAP])]}


@pytest.mark.parametrize("cell", [0.3, 1.0, 100.0])
@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_points_in_polygons(spark, tmp_path, cell, threshold):
    path = tmp_path / "areas.geojson"
    path.write_text(json.dumps(collection(), indent=1))
    polygons = read_geojson(spark, str(path), ["boroname", "ntaname"])
    points = spark.createDataFrame([c[:3] for c in CASES], "name string, longitude double, latitude double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        joined = points_in_polygons(points, polygons, ["boroname", "ntaname"], cell=cell).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name, _, _, want in CASES:
        assert sorted((r["ntaname"] for r in joined if r["name"] == name), key=str) == want, name


def test_spatial_join_is_an_equi_join(spark, tmp_path):
    path = tmp_path / "areas.geojson"
    path.write_text(json.dumps(collection()))
    polygons = read_geojson(spark, str(path), ["ntaname"])
    points = spark.createDataFrame([("p", 0.5, 0.5)], "name string, longitude double, latitude double")
    plan = points_in_polygons(points, polygons, ["ntaname"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def write_archive(folder, name, members):
    with zipfile.ZipFile(folder / name, "w") as z:
        for member, text in members.items():
            z.writestr(member, text)


HEADER = "ride_id,started_at,start_station_id,start_station_name,start_lat,start_lng\n"


@pytest.fixture
def archives(tmp_path):
    write_archive(
        tmp_path,
        "202601-city-tripdata.zip",
        {
            "a.csv": HEADER + '1,2026-01-01 00:10:00.123,5329.10,"West, 21 ""St""",40.5,-73.5\n2,2026-02-01 00:00:00,5329.10,x,40.5,-73.5\n',
            "B.CSV": HEADER + "3,2026-01-31 23:59:59,7,NA,40.0,-73.0\n4,,7,Seven,40.0,-73.0\n5,not a time,7,Seven,,-73.0\n6,2026-01-05 01:00:00,7,Seven,40.2,-73.2\n",
            "notes.txt": "no",
        },
    )
    write_archive(tmp_path, "202602-city-tripdata.zip", {"c.csv": HEADER + "7,2026-02-28 12:00:00,7,Seven,40.4,-73.4\n"})
    write_archive(tmp_path, "unrelated.zip", {"c.csv": "x\n1\n"})
    return tmp_path


def test_zip_archives(spark, archives, rows):
    trips = read_trips(spark, str(archives))
    assert rows(trips) == [
        (datetime(2026, 1, 1, 0, 10, 0, 123000), "5329.10", 'West, 21 "St"'),
        (datetime(2026, 1, 5, 1), "7", "Seven"),
        (datetime(2026, 2, 28, 12), "7", "Seven"),
    ]
    assert trips.rdd.getNumPartitions() == 3


def test_glob_selects_archives(archives):
    assert len(list_archives(f"{archives}/202601*.zip")) == 1
    with pytest.raises(FileNotFoundError, match="no archives"):
        list_archives(f"{archives}/2030??.zip")


def test_station_points_from_archives(spark, archives, rows):
    found = rows(station_metadata(read_station_points(spark, str(archives))))
    assert [(r[0], r[1]) for r in found] == [("5329.10", 'West, 21 "St"'), ("7", "Seven")]
    # "Seven" has four lines, one of them without a latitude.
    assert found[1][2:] == pytest.approx(((40.0 + 40.2 + 40.4) / 3, -(73.0 + 73.2 + 73.4) / 3))


def test_columns_are_found_by_name_in_each_file(spark, tmp_path, rows):
    (tmp_path / "202601-a.csv").write_text(HEADER + "1,2026-01-01 00:10:00,5,x,1,2\n" * 50)
    (tmp_path / "202601-b.csv").write_text("start_station_name,start_station_id,started_at,other\n\"x\ny\",6,2026-01-02 00:10:00,9\n")
    (tmp_path / "202601-c.csv").write_text("ride_id,started_at\n1,2026-01-01 00:10:00\n")
    found = rows(read_trips(spark, f"{tmp_path}/202601-[ab].csv", zipped=False))
    assert found == [(datetime(2026, 1, 1, 0, 10), "5", "x")] * 50 + [(datetime(2026, 1, 2, 0, 10), "6", "x\ny")]
    with pytest.raises(Exception, match="start_station_id"):
        read_trips(spark, str(tmp_path), zipped=False).collect()


def test_archives_and_extracted_files_give_the_same_rows(spark, archives, tmp_path_factory, rows):
    folder = tmp_path_factory.mktemp("extracted")
    for archive in list_archives(str(archives)):
        with zipfile.ZipFile(archive) as z:
            for i, name in enumerate(n for n in z.namelist() if n.lower().endswith(".csv")):
                (folder / f"{archive.split('/')[-1][:6]}-{i}.csv").write_bytes(z.read(name))
    assert rows(read_trips(spark, str(folder), zipped=False)) == rows(read_trips(spark, str(archives)))
    rejected = [(r["archive"][:6], r["started_at"], r["start_station_id"], r["reason"]) for r in rejected_trips(spark, str(folder), zipped=False).collect()]
    assert sorted(rejected, key=str) == sorted([(r["archive"][:6], r["started_at"], r["start_station_id"], r["reason"]) for r in rejected_trips(spark, str(archives)).collect()], key=str)
    assert ("202601", "not a time", "7", UNREADABLE) in rejected and ("202601", "2026-02-01 00:00:00", "5329.10", OTHER_MONTH) in rejected
    assert sorted(r[3] for r in rejected) == sorted([OTHER_MONTH, INCOMPLETE, INCOMPLETE, UNREADABLE])


def test_ingest_raises_on_unreadable_times(spark, archives, tmp_path_factory, capsys):
    out = str(tmp_path_factory.mktemp("ingested") / "trips")
    with pytest.raises(DataQualityError, match="1 of 7 lines"):
        jobs.main(["ingest", "--trips", str(archives), "--out", out])
    assert "unreadable 1, incomplete 2, other_month 1" in capsys.readouterr().out
    assert spark.read.parquet(f"{out}-rejected").count() == 4 and spark.read.parquet(out).count() == 3
    jobs.main(["ingest", "--trips", str(archives), "--out", out, "--allow-unreadable"])


def test_extracted_csv_files(spark, tmp_path, rows):
    (tmp_path / "202601-part.csv").write_text(HEADER + "1,2026-01-01 00:10:00,5329.10,\"a, b\",1,2\n2,2026-03-01 00:10:00,5,x,1,2\n")
    assert rows(read_trips(spark, str(tmp_path), zipped=False)) == [(datetime(2026, 1, 1, 0, 10), "5329.10", "a, b")]


def response(names, count=48, first="2026-01-01", **changed):
    stamps = [t.strftime("%Y-%m-%dT%H:%M") for t in hours(first, count)]
    hourly = {v: stamps if c == "timestamp" else [float(i) for i in range(count)] for v, c in names.items()}
    code = next(v for v, c in names.items() if c == "weather_code")
    hourly[code] = list(range(count))
    hourly.update(changed)
    return {"latitude": 1, "hourly_units": {"time": "iso8601"}, "hourly": {k: v for k, v in hourly.items() if v is not None}}


def landed(tmp_path, document):
    path = tmp_path / "response.json"
    path.write_text(json.dumps(document, indent=2))
    return str(path)


DAY = (datetime(2026, 1, 1), datetime(2026, 1, 2, 23))


@pytest.mark.parametrize("names", [OBSERVED_WEATHER_NAMES, DAY_AHEAD_WEATHER_NAMES])
def test_weather_response(spark, tmp_path, names, rows):
    path = landed(tmp_path, response(names))
    weather = read_weather(spark, path, names, *DAY)
    assert weather.columns == list(OBSERVED_WEATHER_NAMES.values())
    assert dict(weather.dtypes)["weather_code"] == "int" and weather.count() == 48
    assert rows(weather)[5][:2] == (datetime(2026, 1, 1, 5), 5.0)
    assert rows(units(read_responses(spark, path, names))) == [("time", "iso8601")]


@pytest.mark.parametrize(
    ("changed", "message"),
    [
        ({"precipitation": None}, "weather variables are absent: precipitation in 1 of 1"),
        ({"precipitation": [1.0] * 47}, "lack values.*precipitation_mm.*1"),
        ({"temperature_2m": [None] + [1.0] * 47}, "lack values.*temperature_c"),
        ({"time": ["2026-01-01T00:00"] * 2 + [t.strftime("%Y-%m-%dT%H:%M") for t in hours("2026-01-01T02:00", 46)]}, "several weather rows claim the same hour"),
        ({"time": [t.strftime("%Y-%m-%dT%H:%M") for t in hours("2026-01-01T01:00", 48)]}, "1 hours between 2026-01-01 00:00:00 and"),
    ],
)
def test_broken_weather_responses(spark, tmp_path, changed, message):
    path = landed(tmp_path, response(OBSERVED_WEATHER_NAMES, **changed))
    with pytest.raises(DataQualityError, match=message):
        read_weather(spark, path, OBSERVED_WEATHER_NAMES, *DAY)


def test_response_without_hourly_and_bad_time(spark, tmp_path):
    with pytest.raises(DataQualityError, match="1 of 1 weather documents have no 'hourly'"):
        read_weather(spark, landed(tmp_path, {"error": True}), OBSERVED_WEATHER_NAMES, *DAY)
    path = landed(tmp_path, response(OBSERVED_WEATHER_NAMES, count=1, time=["soon"]))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        hourly_rows(read_responses(spark, path, OBSERVED_WEATHER_NAMES), OBSERVED_WEATHER_NAMES).collect()


def test_monthly_table_prunes_months(spark, tmp_path):
    df = spark.range(60).select(
        (F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("timestamp"),
        F.lit("a").alias("station_id"), F.lit("A").alias("station_name"), F.lit(1).alias("pickups"),
    )
    write_monthly(df, str(tmp_path / "t"))
    february = read_months(spark, str(tmp_path / "t"), "2026-02", "2026-02")
    assert february.count() == 28
    assert len(february.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(month_label" in february._jdf.queryExecution().executedPlan().toString()


def test_missing_input_names_the_stage(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="run the 'dataset' stage first"):
        require_input(spark, str(tmp_path / "nothing"), "dataset")


def test_stages_end_to_end(spark, tmp_path, capsys):
    """Archives to neighbourhoods, features and baseline through the job entry points."""
    raw = tmp_path / "raw"
    raw.mkdir()
    lines = [f"{i},{t:%Y-%m-%d %H:%M:%S},{s},Name {s},{0.5 + 3 * s},{0.5}\n" for i, t in enumerate(hours("2026-01-01", 31 * 24)) for s in (0, 1) if (i + s) % 3]
    write_archive(raw, "202601-x-tripdata.zip", {"m.csv": HEADER.replace("start_lat,start_lng", "start_lng,start_lat") + "".join(lines)})
    out = {n: str(tmp_path / n) for n in ("trips", "pickups", "stations", "weather", "features", "areas")}
    jobs.main(["ingest", "--trips", str(raw), "--out", out["trips"]])
    jobs.main(["dataset", "--trips", out["trips"], "--out", out["pickups"], "--cutoff", "2026-01-25", "--top-n", "2"])
    jobs.main(["stations", "--trips", str(raw), "--out", out["stations"]])
    path = landed(tmp_path, response(DAY_AHEAD_WEATHER_NAMES, count=31 * 24))
    jobs.main(["weather", "--response", path, "--day-ahead", "--first", "2026-01-01", "--last", "2026-01-31T23:00", "--out", out["weather"]])
    jobs.main(["features", "--pickups", out["pickups"], "--weather", out["weather"], "--out", out["features"]])
    jobs.main(["baseline", "--pickups", out["pickups"]])
    assert "last_week" in capsys.readouterr().out
    features = spark.read.parquet(out["features"])
    assert features.count() == 2 * (744 - 336) and len(features.columns) == 25
    polygons = tmp_path / "areas.geojson"
    polygons.write_text(json.dumps(collection()))
    jobs.main(["neighborhoods", "--pickups", out["pickups"], "--stations", out["stations"], "--polygons", str(polygons), "--out", out["areas"]])
    areas = spark.read.parquet(out["areas"]).collect()
    assert [(r["ntaname"], r["selected_stations"]) for r in areas] == [("A", 2)]
    jobs.main(
        ["evaluate", "--features", out["features"], "--out", str(tmp_path / "eval"), "--folds", "2026-01-22", "2026-01-25", "--fold-days", "3"]
        + ["--test-start", "2026-01-28", "--test-end", "2026-02-01", "--test-rows", str(2 * 4 * 24), "--trees", "2"]
    )
    final = spark.read.parquet(str(tmp_path / "eval" / "final_test"))
    assert {r["model"] for r in final.collect()} == {"yesterday", "last_week", "gradient_boosting", "gradient_boosting_weather"}
    assert spark.read.parquet(str(tmp_path / "eval" / "folds")).count() == 2 * 4
    jobs.main(["errors", "--predictions", str(tmp_path / "eval" / "predictions"), "--features", out["features"], "--out", str(tmp_path / "errors")])
    counts = {n: spark.read.parquet(str(tmp_path / "errors" / n)).count() for n in ("by_day", "by_hour", "by_station", "largest_misses", "inactive_months")}
    assert counts == {"by_day": 4, "by_hour": 24, "by_station": 2, "largest_misses": 20, "inactive_months": 0}
    jobs.main(["explore", "--pickups", out["pickups"], "--weather", out["weather"], "--months", "2026-01", "2026-01", "--out", str(tmp_path / "eda")])
    assert spark.read.parquet(str(tmp_path / "eda" / "describe")).first()["count"] == 2 * 744
    assert spark.read.parquet(str(tmp_path / "eda" / "daily")).count() == 31
    jobs.main(["importance", "--features", out["features"], "--out", str(tmp_path / "imp"), "--test-start", "2026-01-28", "--test-end", "2026-02-01", "--trees", "2", "--repeats", "2"])
    assert spark.read.parquet(str(tmp_path / "imp")).count() == 22


def test_a_round_polygon_on_a_fine_grid(spark):
    """Many vertices and cells: the result is the same as testing the distance, for negative places too."""
    corners = [[-74 + math.cos(2 * math.pi * i / 720), 40 + math.sin(2 * math.pi * i / 720)] for i in range(720)]
    polygons = spark.createDataFrame([("disc", [[[*corners, corners[0]]]])], "ntaname string, geometry array<array<array<array<double>>>>")
    rng = np.random.default_rng(5)
    places = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-1.2, 1.2, (400, 2)) + [-74, 40])]
    points = spark.createDataFrame(places, "id int, longitude double, latitude double")
    for cell in (0.05, 0.7):
        joined = points_in_polygons(points, polygons, ["ntaname"], cell=cell).collect()
        assert len(joined) == 400
        for r in joined:
            distance = math.hypot(r["longitude"] + 74, r["latitude"] - 40)
            if abs(distance - 1) > 1e-4:
                assert (r["ntaname"] == "disc") == (distance < 1)
    repeated = polygon_cells(polygons, "geometry", ["ntaname"], 0.05).agg(F.sum(F.size("_edges")), F.count("*")).first()
    assert repeated[0] < 0.2 * 720 * repeated[1]


def test_cells_follow_the_edges_and_not_the_extent(spark):
    ring = lambda w, h: [[0.0, 0.0], [w, 0.0], [w, h], [0.0, h], [0.0, 0.0]]
    kind = "ntaname string, geometry array<array<array<array<double>>>>"
    count = lambda w, h: polygon_cells(spark.createDataFrame([("box", [[ring(w, h)]])], kind), "geometry", ["ntaname"], 0.01).count()
    assert count(20.0, 10.0) <= 8 and count(2e-5, 1e-5) <= 8
    # a comb of many teeth has few cells for each of its edges
    teeth = [[i / 100, (i % 2) * 5.0] for i in range(1001)]
    comb = spark.createDataFrame([("comb", [[[*teeth, [10.0, -1.0], [0.0, -1.0], teeth[0]]]])], kind)
    assert polygon_cells(comb, "geometry", ["ntaname"], 0.01).count() < 8 * 1003
    rng = np.random.default_rng(3)
    places = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform((-0.5, -1.5), (10.5, 5.5), (500, 2)))]
    points = spark.createDataFrame(places, "id int, longitude double, latitude double")
    joined = points_in_polygons(points, comb, ["ntaname"])
    height = lambda x: abs((x * 100 + 1) % 2 - 1) * 5
    for r in joined.collect():
        if abs(r["latitude"] - height(r["longitude"])) > 1e-6:
            assert (r["ntaname"] == "comb") == (0 < r["longitude"] < 10 and -1 < r["latitude"] < height(r["longitude"]))
    assert joined.count() == 500


def test_no_polygons_leave_the_points(spark):
    polygons = spark.createDataFrame([("flat", [])], "ntaname string, geometry array<array<array<array<double>>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5)], "id int, longitude double, latitude double")
    for empty in (polygons, polygons.limit(0)):
        assert [tuple(r) for r in points_in_polygons(points, empty, ["ntaname"]).collect()] == [(1, 0.5, 0.5, None)]


def test_input_order_does_not_matter(spark, rows):
    trips = [(datetime(2026, 1, 1 + i % 20, i % 24, i % 60), f"s{i % 7}", f"n{i % 3}") for i in range(900)]
    schema = "started_at timestamp_ntz, start_station_id string, start_station_name string"
    one = build_dataset(spark.createDataFrame(trips, schema), date(2026, 1, 15), 4)
    other = build_dataset(spark.createDataFrame(trips[::-1], schema).repartition(7), date(2026, 1, 15), 4)
    assert rows(one) == rows(other)
