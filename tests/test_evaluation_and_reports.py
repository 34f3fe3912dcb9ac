from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.operators import profile as profiles
from hourgrid.operators import reports
from hourgrid.operators.evaluation import (
    assign_folds,
    best_other,
    fixed_test,
    improvement_by_model,
    improvement_over_best,
    metrics_by_model,
    summarize_folds,
    trailing_split,
)
from hourgrid.operators.quality import DataQualityError
from hourgrid.plans.evaluation import evaluate_baselines
from tests.helpers import dense, frame


def test_baselines_equal_pandas(spark):
    df, pdf = dense(spark, 3, 24 * 20)
    by = pdf.groupby("station_id")["pickups"]
    pdf["yesterday"], pdf["last_week"] = by.shift(24), by.shift(168)
    test = pdf[pdf["timestamp"] >= pdf["timestamp"].max().normalize() - np.timedelta64(6, "D")]
    got = {r["model"]: (r["MAE"], r["RMSE"]) for r in evaluate_baselines(df).collect()}
    for model in ("yesterday", "last_week"):
        e = test[model] - test["pickups"]
        assert got[model] == pytest.approx((e.abs().mean(), np.sqrt((e**2).mean())))


def test_short_series_has_no_lag_rows(spark):
    df, _ = dense(spark, 1, 24 * 8)
    got = {r["model"]: r["MAE"] for r in evaluate_baselines(df).collect()}
    assert set(got) == {"yesterday", "last_week"} and all(v is not None for v in got.values())


def test_trailing_split_counts_calendar_days(spark):
    df, _ = dense(spark, 1, 24 * 9 + 5)
    train, test = trailing_split(df, 7)
    assert test.agg(F.min("timestamp")).first()[0] == datetime(2024, 1, 4)
    assert train.count() + test.count() == df.count()


def test_fixed_test_guards_its_rows(spark):
    df, _ = dense(spark, 2, 72)
    assert fixed_test(df, date(2024, 1, 2), date(2024, 1, 3), 48).count() == 48
    with pytest.raises(DataQualityError, match="expected 47"):
        fixed_test(df, date(2024, 1, 2), date(2024, 1, 3), 47)


def test_folds_may_overlap(spark, rows):
    df, _ = dense(spark, 1, 24 * 5)
    folded = assign_folds(df, [date(2024, 1, 2), date(2024, 1, 3)], 2)
    assert rows(folded.groupBy("validation_week").agg(F.count("*"), F.min("timestamp"), F.max("timestamp"))) == [
        (date(2024, 1, 2), 48, datetime(2024, 1, 2), datetime(2024, 1, 3, 23)),
        (date(2024, 1, 3), 48, datetime(2024, 1, 3), datetime(2024, 1, 4, 23)),
    ]


def test_summary_and_improvement(spark, rows):
    results = spark.createDataFrame(
        [(1, "a", 4.0, 1.0), (2, "a", 2.0, 1.0), (1, "b", 4.0, 3.0), (1, "ml", 2.4, 1.0)], "f int, model string, MAE double, RMSE double"
    )
    summary = summarize_folds(results)
    values = {r["model"]: r for r in summary.collect()}
    assert values["a"]["mean_MAE"] == 3.0 and values["a"]["std_MAE"] == pytest.approx(np.sqrt(2)) and values["b"]["std_MAE"] is None
    assert rows(best_other(summary, "ml")) == [("a", 3.0)]
    assert rows(improvement_over_best(summary, "ml").select("best_model", F.round("improvement", 6))) == [("a", 0.2)]
    assert rows(improvement_by_model(summary, "b").select("model", F.round("MAE_improvement", 6))) == [("a", 0.25), ("ml", 0.4)]


def test_metrics_per_key(spark):
    df = spark.createDataFrame([("x", 1, 2.0, 1.0), ("x", 3, 1.0, 3.0), ("y", 0, 3.0, 0.0)], "k string, pickups int, p double, q double")
    got = {(r["k"], r["model"]): (r["MAE"], r["RMSE"]) for r in metrics_by_model(df, {"P": "p", "Q": "q"}, keys=["k"]).collect()}
    assert got[("x", "P")] == pytest.approx((1.5, np.sqrt(2.5))) and got[("y", "P")] == (3.0, 3.0) and got[("x", "Q")] == (0.0, 0.0)


def errors_of(spark, cells):
    schema = "timestamp timestamp_ntz, station_id string, station_name string, pickups int, guess double"
    return reports.error_frame(frame(spark, cells, schema), "guess", ["timestamp", "station_id", "station_name", "pickups"])


def test_error_report_sums_agree_and_zero_actuals_give_null(spark):
    cells = [(datetime(2024, 5, d, h), s, s.upper(), p, g) for d, h, s, p, g in [(1, 0, "a", 0, 2.0), (1, 1, "a", 0, -3.0), (2, 0, "b", 4, 5.0), (2, 1, "b", 6, 5.0)]]
    errors = errors_of(spark, cells)
    stations = {r["station_id"]: r for r in reports.error_by(errors, ["station_id", "station_name"]).collect()}
    assert stations["a"]["relative_error_pct"] is None and stations["a"]["predicted_pickups"] == 2.0
    assert stations["b"]["bias"] == 0.0 and stations["b"]["mae"] == 1.0 and stations["b"]["relative_error_pct"] == 0.0
    by_day = reports.error_by(errors.withColumn("date", F.to_date("timestamp")), ["date"])
    by_hour = reports.error_by(errors.withColumn("hour", F.hour("timestamp")), ["hour"])
    total = [df.agg(F.sum("total_error"), F.sum("actual_pickups")).first() for df in (by_day, by_hour, reports.error_by(errors, ["station_id"]))]
    assert total[0] == total[1] == total[2]
    by_station = reports.error_by(errors, ["station_id"])
    assert [r[0] for r in reports.inactive(by_station).select("station_id").collect()] == ["a"]
    assert [r[0] for r in reports.worst(by_station, 10).select("station_id").collect()] == ["b"]


def test_largest_misses_break_ties_by_time_and_station(spark, rows):
    cells = [(datetime(2024, 5, 1, h), s, s, 1, 1.0 + e) for h, s, e in [(2, "a", 3.0), (1, "b", -0.5), (1, "a", 3.0), (1, "b", 3.0), (0, "c", 0.0)]]
    misses = reports.largest_misses(errors_of(spark, cells), 4)
    assert [(r["timestamp"].hour, r["station_id"]) for r in misses.collect()] == [(1, "a"), (1, "b"), (2, "a"), (1, "b")]
    assert rows(reports.misses_by_direction(misses)) == [("overprediction", 3, 3.0, 3.0), ("underprediction", 1, 0.5, 0.5)]
    assert [tuple(r) for r in reports.misses_by_hour(misses).collect()] == [(1, 3), (2, 1)]


def test_monthly_activity_of_inactive_stations(spark, rows):
    cells = [(datetime(2024, 4, 30, 23), "a", "A", 3), (datetime(2024, 4, 30, 22), "a", "A", 0), (datetime(2024, 5, 1), "a", "A", 0), (datetime(2024, 5, 1), "b", "B", 1)]
    grid = frame(spark, cells, "timestamp timestamp_ntz, station_id string, station_name string, pickups int")
    listed = spark.createDataFrame([("a",)], "station_id string")
    assert rows(reports.monthly_activity(grid, listed)) == [("a", "A", "2024-04", 3, 1, 2), ("a", "A", "2024-05", 0, 0, 1)]


def test_daily_weather_counts_each_hour_once(spark, rows):
    schema = "timestamp timestamp_ntz, temperature_c double, precipitation_mm double, is_precipitating tinyint"
    df = frame(spark, [(datetime(2024, 5, 1, h), 10.0 + h, 1.5 * h, int(h > 0)) for h in (0, 1) for _ in range(3)], schema)
    assert rows(reports.daily_weather_of(df)) == [(date(2024, 5, 1), 10.5, 1.5, 1)]


@pytest.mark.parametrize("values_each", [100, 200, profiles.RANGE_VALUES])
@pytest.mark.parametrize("seed", [1, 2])
def test_describe_is_exact(spark, monkeypatch, seed, values_each):
    monkeypatch.setattr(profiles, "RANGE_VALUES", values_each)
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.normal(100, 30, 3001), np.full(1500, 42.0)]) if seed == 1 else rng.poisson(2, 1000).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "pickups double")
    got = profiles.describe_exact(df).first()
    assert got["count"] == len(values)
    want = (values.mean(), values.std(ddof=1), values.min(), *np.percentile(values, [25, 50, 75]), values.max())
    assert tuple(got)[1:] == pytest.approx(want, rel=1e-12)


def test_describe_of_one_value_and_of_none(spark):
    one = profiles.describe_exact(spark.createDataFrame([(5,)], "pickups int")).first()
    assert tuple(one) == (1, 5.0, None, 5.0, 5.0, 5.0, 5.0, 5.0)
    none = profiles.describe_exact(spark.createDataFrame([], "pickups int")).first()
    assert none["count"] == 0 and none["p50"] is None


def test_value_counts_and_shares(spark, rows):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "b string")
    assert [tuple(r) for r in profiles.value_counts(df, "b").collect()] == [("x", 2), ("y", 1)]
    located = spark.createDataFrame([("1", 3, "M", "a"), ("2", 1, "M", "a"), ("3", 4, "B", "b"), ("4", 9, None, None)], "station_id string, pickups int, boroname string, ntaname string")
    assert rows(profiles.area_summary(located)) == [("B", "b", 1, 4, 4.0, 0.5), ("M", "a", 2, 4, 2.0, 0.5)]


def test_hourly_profile_averages_system_totals(spark, rows):
    df, pdf = dense(spark, 2, 24 * 7)
    system = pdf.groupby("timestamp")["pickups"].sum().reset_index()
    weekend = system["timestamp"].dt.dayofweek >= 5
    want = system.groupby([system["timestamp"].dt.hour, weekend])["pickups"].mean().unstack()
    got = profiles.hourly_profile(df).orderBy("hour").collect()
    assert [(r["Weekday"], r["Weekend"]) for r in got] == [(pytest.approx(a), pytest.approx(b)) for a, b in want.to_numpy()]
