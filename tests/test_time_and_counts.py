from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hourgrid.functions import errors
from hourgrid.functions.time import add_calendar, first_hour_of_month, floor_hour, hour_calendar, last_hour_of_month, naive
from hourgrid.operators.counts import blank_to_null, hourly_counts, sum_by, within_month
from hourgrid.operators.grid import dense_grid
from hourgrid.operators.joins import keep_listed
from hourgrid.operators.quality import DataQualityError
from hourgrid.operators.ranking import canonical_label, require_selection, top_entities
from hourgrid.plans.dataset import build_dataset
from tests.helpers import frame

TRIPS = "started_at timestamp_ntz, start_station_id string, start_station_name string"


def test_hour_skipped_by_daylight_saving_is_kept(spark, rows):
    trips = frame(spark, [(datetime(2026, 3, 8, 2, 30), "a", "A")], TRIPS)
    assert rows(hourly_counts(trips)) == [(datetime(2026, 3, 8, 2), "a", "A", 1)]
    day = hour_calendar(spark, datetime(2026, 3, 8), datetime(2026, 3, 8, 23))
    assert [t.hour for (t,) in rows(day)] == list(range(24))


def test_hour_calendar_has_every_hour_of_a_partial_range(spark, rows):
    found = rows(hour_calendar(spark, datetime(2025, 12, 31, 22), datetime(2026, 1, 2, 1)))
    assert len(found) == 28 and found[0][0] == datetime(2025, 12, 31, 22) and found[-1][0] == datetime(2026, 1, 2, 1)


def test_floor_before_1970_and_month_bounds(spark, rows):
    df = frame(spark, [(datetime(1969, 12, 31, 23, 59, 59, 999999),)], "t timestamp_ntz")
    assert rows(df.select(floor_hour("t"))) == [(datetime(1969, 12, 31, 23),)]
    leap = frame(spark, [(datetime(2024, 2, 10, 5, 6),)], "t timestamp_ntz")
    bounds = leap.select(first_hour_of_month("t"), last_hour_of_month("t"))
    assert rows(bounds) == [(datetime(2024, 2, 1), datetime(2024, 2, 29, 23))]


def test_week_starts_on_monday(spark, rows):
    stamps = [(datetime(2024, 1, d),) for d in (1, 5, 6, 7)]
    df = add_calendar(frame(spark, stamps, "timestamp timestamp_ntz"))
    assert rows(df, "day_of_week", "is_weekend") == [(0, 0), (4, 0), (5, 1), (6, 1)]
    assert df.schema["is_weekend"].dataType.simpleString() == "tinyint"


def test_nulls_in_any_key_are_dropped_and_ids_stay_text(spark, rows):
    t = datetime(2026, 1, 1, 4, 5)
    trips = frame(spark, [(t, "5329.10", "x"), (None, "a", "x"), (t, None, "x"), (t, "a", None)], TRIPS)
    assert rows(hourly_counts(trips)) == [(datetime(2026, 1, 1, 4), "5329.10", "x", 1)]


def test_texts_that_mean_missing(spark, rows):
    df = blank_to_null(spark.createDataFrame([("NA",), ("",), ("Nassau",), (None,)], "v string"), ["v"])
    assert [r[0] for r in df.collect()] == [None, None, "Nassau", None]


def test_trip_outside_its_archive_month_is_dropped(spark, rows):
    df = frame(
        spark,
        [(datetime(2026, 2, 1), datetime(2026, 1, 1)), (datetime(2026, 1, 31, 23, 59), datetime(2026, 1, 1))],
        "ts timestamp_ntz, month timestamp_ntz",
    )
    assert rows(within_month(df, "ts", "month"), "ts") == [(datetime(2026, 1, 31, 23, 59),)]


def test_null_group_key_belongs_to_no_group(spark, rows):
    df = spark.createDataFrame([("a", 1), (None, 5), ("a", 2)], "k string, pickups int")
    assert rows(sum_by(df, ["k"])) == [("a", 3)]


def test_canonical_name_prefers_total_then_lower_name(spark, rows):
    df = spark.createDataFrame([("1", "b", 3), ("1", "a", 3), ("2", "a", 3), ("2", "z", 5)], "id string, name string, n long")
    assert rows(canonical_label(df, "id", "name", "n")) == [("1", "a"), ("2", "z")]


def test_top_ties_go_to_the_lower_id_and_late_demand_does_not_count(spark, rows):
    early, late = datetime(2024, 1, 1), datetime(2024, 2, 1)
    hourly = frame(
        spark,
        [(early, "b", 5), (early, "a", 5), (early, "c", 9), (late, "d", 999), (late, "a", 1)],
        "timestamp timestamp_ntz, station_id string, pickups long",
    )
    top = top_entities(hourly, "station_id", "pickups", 2, cutoff=naive("2024-02-01"))
    assert rows(top) == [("a", 5), ("c", 9)]
    with pytest.raises(DataQualityError, match="only 3"):
        require_selection(top_entities(hourly, "station_id", "pickups", 4, cutoff=naive("2024-02-01")), 4)
    with pytest.raises(DataQualityError, match="no data"):
        require_selection(top_entities(hourly, "station_id", "pickups", 4, cutoff=naive("2020-01-01")), 4)


def test_grid_is_complete_and_keeps_the_sum(spark):
    hourly = frame(
        spark,
        [(datetime(2026, 3, 5, 7), "a", 2), (datetime(2026, 4, 2, 3), "b", 4), (datetime(2026, 1, 1), "z", 9)],
        "timestamp timestamp_ntz, station_id string, pickups long",
    )
    members = spark.createDataFrame([("a",), ("b",)], "station_id string")
    grid = dense_grid(keep_listed(hourly, members, "station_id"), members, "station_id", "pickups")
    facts = grid.agg(F.count("*"), F.sum("pickups"), F.min("timestamp"), F.max("timestamp"), F.count_distinct("timestamp", "station_id")).first()
    assert tuple(facts) == ((31 + 30) * 24 * 2, 6, datetime(2026, 3, 1), datetime(2026, 4, 30, 23), (31 + 30) * 24 * 2)


def test_grid_of_odd_rows(spark, rows):
    january, march = datetime(2026, 1, 31, 23), datetime(2026, 3, 1)
    counts = [(january, "a", 2), (january, "a", 3), (march, "a", None), (None, "a", 7), (january, None, 5), (datetime(2026, 2, 3, 4, 30), "a", 9)]
    hourly = frame(spark, counts, "timestamp timestamp_ntz, station_id string, pickups long")
    members = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "station_id string")
    grid = dense_grid(hourly, members, "station_id", "pickups")
    assert grid.columns == ["timestamp", "station_id", "pickups"] and dict(grid.dtypes)["pickups"] == "int"
    assert rows(grid.where("pickups <> 0")) == [(january, "a", 5)] * 2
    assert grid.count() == 4 * 24 * (31 + 28 + 31) == grid.where("pickups IS NOT NULL").count()
    assert dense_grid(hourly.limit(0), members, "station_id", "pickups").count() == 0


def test_dataset_zero_fills_a_station_that_stops(spark):
    trips = [(datetime(2026, 1, d, 8), "a", "A") for d in range(1, 20)] + [(datetime(2026, 2, 3), "b", "B")]
    trips += [(datetime(2026, 1, 2), "b", "B"), (datetime(2026, 2, 4), "late", "L")] + [(datetime(2026, 2, 4), "late", "L")] * 50
    df = build_dataset(frame(spark, trips, TRIPS), cutoff=datetime(2026, 2, 1).date(), top_n=2)
    per_station = {r["station_id"]: (r["n"], r["s"], r["m"]) for r in df.groupBy("station_id").agg(F.count("*").alias("n"), F.sum("pickups").alias("s"), F.max("station_name").alias("m")).collect()}
    assert per_station == {"a": (59 * 24, 19, "A"), "b": (59 * 24, 2, "B")}
    february = df.where((F.col("timestamp") >= naive("2026-02-01")) & (F.col("station_id") == "a"))
    assert february.agg(F.sum("pickups")).first()[0] == 0


def test_a_station_with_most_trips_is_counted_like_any_other(spark):
    hot = spark.range(90_000).select(
        (naive("2026-01-01") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 7200).cast("decimal(18,6)"))).alias("started_at"),
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("start_station_id"),
        F.lit("n").alias("start_station_name"),
    )
    counted = hourly_counts(hot)
    totals = {r[0]: r[1] for r in sum_by(counted, ["start_station_id"]).collect()}
    assert totals["hot"] == 60_000 and sum(totals.values()) == 90_000
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count(1)") == 1


def test_error_expressions(spark):
    df = spark.createDataFrame([(0.0, 0.125), (2.0, -1.0)], "a double, p double")
    picked = df.select(
        errors.direction(F.col("p") - F.col("a")).alias("d"),
        errors.relative_pct(F.col("p") - F.col("a"), F.col("a")).alias("pct"),
        errors.half_even(F.col("p"), 2).alias("even"),
        errors.clip_at_zero(F.col("p")).alias("clip"),
        errors.direction(F.lit(0.0)).alias("zero"),
    ).collect()
    assert [tuple(r) for r in picked] == [
        ("overprediction", None, 0.12, 0.125, "underprediction"),
        ("underprediction", -150.0, -1.0, 0.0, "underprediction"),
    ]
