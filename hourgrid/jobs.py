"""Entry points of the stages: ``spark-submit hourgrid/jobs.py <stage> ...`` or ``python -m hourgrid.jobs``.

Every stage reads what the one before it wrote and says so when that is missing.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions.time import naive
from hourgrid.models.configurations import CONFIGURATIONS, FORECAST_FEATURES, demand_pipeline
from hourgrid.models.importance import permutation_importance
from hourgrid.operators.counts import sum_by
from hourgrid.operators.evaluation import fixed_test, improvement_over_best, summarize_folds
from hourgrid.operators.joins import join_checked
from hourgrid.operators.profile import area_summary, daily_demand, daily_weather, describe_exact, hourly_profile, profile
from hourgrid.operators.quality import DataQualityError, require_columns
from hourgrid.operators.reports import (
    active,
    error_by,
    error_frame,
    errors_by_day_with_weather,
    inactive,
    largest_misses,
    misses_by_direction,
    misses_by_hour,
    monthly_activity,
)
from hourgrid.operators.spatial import points_in_polygons
from hourgrid.operators.stations import station_metadata
from hourgrid.plans.dataset import build_dataset, ingest_trips
from hourgrid.plans.evaluation import evaluate_baselines, run_backtest, run_final_test
from hourgrid.plans.features import build_features, require_weather_seen
from hourgrid.schemas import DAY_AHEAD_WEATHER_NAMES, OBSERVED_WEATHER_NAMES, TRIP_COLUMNS
from hourgrid.session import materialize
from hourgrid.sources.geojson import read_geojson
from hourgrid.sources.tables import read_monthly, read_months, read_table, require_input, write_monthly, write_table
from hourgrid.sources.trips import read_station_points, read_trips, rejected_trips
from hourgrid.sources.weather import read_weather


def ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    """Write the trips; lines whose time cannot be read go to a table beside them and fail the stage at its end."""
    require_input(spark, args.trips, "landing the monthly trip files")
    seen = Observation("lines")
    ingest_trips(read_trips(spark, args.trips, zipped=not args.csv, seen=seen), args.out)
    counted = seen.get
    print(", ".join(f"{name} {n:,}" for name, n in counted.items()))
    if counted["unreadable"]:
        beside = f"{args.out.rstrip('/')}-rejected"
        write_table(rejected_trips(spark, args.trips, zipped=not args.csv), beside)
        if not args.allow_unreadable:
            raise DataQualityError(f"{counted['unreadable']:,} of {counted['lines']:,} lines have a time that cannot be read; they are listed in {beside}")


def dataset(spark: SparkSession, args: argparse.Namespace) -> None:
    require_input(spark, args.trips, "ingest")
    trips = read_table(spark, args.trips)
    require_columns(trips, TRIP_COLUMNS)
    write_monthly(build_dataset(trips, args.cutoff, args.top_n), args.out)
    profile(read_monthly(spark, args.out)).show(truncate=False)


def stations(spark: SparkSession, args: argparse.Namespace) -> None:
    require_input(spark, args.trips, "landing the monthly trip files")
    write_table(station_metadata(read_station_points(spark, args.trips, zipped=not args.csv)), args.out)


def weather(spark: SparkSession, args: argparse.Namespace) -> None:
    require_input(spark, args.response, "landing the weather response")
    names = DAY_AHEAD_WEATHER_NAMES if args.day_ahead else OBSERVED_WEATHER_NAMES
    write_table(read_weather(spark, args.response, names, args.first, args.last), args.out)


def features(spark: SparkSession, args: argparse.Namespace) -> None:
    require_input(spark, args.pickups, "dataset")
    require_input(spark, args.weather, "weather")
    seen = Observation("weather")
    write_table(build_features(read_monthly(spark, args.pickups), read_table(spark, args.weather), seen), args.out)
    require_weather_seen(seen)


def baseline(spark: SparkSession, args: argparse.Namespace) -> None:
    require_input(spark, args.pickups, "dataset")
    evaluate_baselines(read_monthly(spark, args.pickups), args.test_days).show(truncate=False)


def _chosen_months(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    require_input(spark, args.pickups, "dataset")
    return read_months(spark, args.pickups, *args.months) if args.months else read_monthly(spark, args.pickups)


def explore(spark: SparkSession, args: argparse.Namespace) -> None:
    """Profile, distribution, daily cycle, station totals and daily weather of some months."""
    require_input(spark, args.weather, "weather")
    pickups = _chosen_months(spark, args)
    daily = join_checked(daily_demand(pickups), daily_weather(read_table(spark, args.weather)), "date", "inner", "one_to_one")
    reports = {
        "profile": profile(pickups),
        "describe": describe_exact(pickups),
        "hourly_profile": hourly_profile(pickups).orderBy("hour"),
        "station_totals": sum_by(pickups, ["station_id", "station_name"]).orderBy("pickups"),
        "daily": daily.orderBy("date"),
    }
    for name, report in reports.items():
        write_table(report, f"{args.out}/{name}")


def errors(spark: SparkSession, args: argparse.Namespace) -> None:
    """Where one model misses on the final test: by day, hour and station, and its largest misses."""
    require_input(spark, args.predictions, "evaluate")
    require_input(spark, args.features, "features")
    kept = ["timestamp", "station_id", "station_name", "pickups", "hour", "temperature_c", "precipitation_mm", "is_precipitating"]
    frame = materialize(error_frame(read_table(spark, args.predictions), args.model, kept), "errors")
    stations = materialize(error_by(frame, ["station_id", "station_name"]), "station_errors")
    misses = materialize(largest_misses(frame), "misses")
    reports = {
        "by_day": errors_by_day_with_weather(frame).orderBy("date"),
        "by_hour": error_by(frame, ["hour"]).orderBy("hour"),
        "by_station": stations.orderBy(F.desc("mae")),
        "active_stations": active(stations).orderBy(F.desc("mae")),
        "inactive_months": monthly_activity(read_table(spark, args.features), inactive(stations)),
        "largest_misses": misses.orderBy(F.desc("absolute_error"), "timestamp", "station_id"),
        "misses_by_direction": misses_by_direction(misses),
        "misses_by_hour": misses_by_hour(misses),
    }
    for name, report in reports.items():
        write_table(report, f"{args.out}/{name}")


def neighborhoods(spark: SparkSession, args: argparse.Namespace) -> None:
    require_input(spark, args.stations, "stations")
    require_input(spark, args.polygons, "landing the polygon file")
    totals = sum_by(_chosen_months(spark, args), ["station_id", "station_name"])
    places = read_table(spark, args.stations).select("station_id", "latitude", "longitude")
    located = join_checked(totals, places, "station_id", "left", "one_to_one")
    polygons = read_geojson(spark, args.polygons, ["boroname", "ntaname"])
    summary = area_summary(points_in_polygons(located, polygons, ["boroname", "ntaname"]))
    write_table(summary, args.out)


def _write_and_show(df: DataFrame, path: str) -> None:
    write_table(df, path)
    read_table(df.sparkSession, path).show(truncate=False)


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    require_input(spark, args.features, "features")
    table = read_table(spark, args.features)
    folds = materialize(run_backtest(table, args.folds, args.fold_days, trees=args.trees), "folds")
    summary = materialize(summarize_folds(folds), "summary")
    write_table(folds.orderBy("validation_week", "MAE"), f"{args.out}/folds")
    _write_and_show(summary.orderBy("mean_MAE"), f"{args.out}/summary")
    for name in CONFIGURATIONS:
        improvement_over_best(summary, name).show(truncate=False)
    metrics, scored = run_final_test(table, args.test_start, args.test_end, args.test_rows, trees=args.trees)
    _write_and_show(metrics, f"{args.out}/final_test")
    write_table(scored, f"{args.out}/predictions")


def importance(spark: SparkSession, args: argparse.Namespace) -> None:
    require_input(spark, args.features, "features")
    table = read_table(spark, args.features)
    train = table.where(table["timestamp"] < naive(args.test_start))
    model = demand_pipeline(FORECAST_FEATURES, "prediction", trees=args.trees).fit(train)
    test = fixed_test(table, args.test_start, args.test_end)
    _write_and_show(permutation_importance(model, test, FORECAST_FEATURES, repeats=args.repeats), args.out)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="hourgrid", description=__doc__)
    stages = parser.add_subparsers(dest="stage", required=True)

    def stage(run, *required: str) -> argparse.ArgumentParser:
        sub = stages.add_parser(run.__name__, help=run.__doc__)
        sub.set_defaults(run=run)
        for name in required:
            sub.add_argument(f"--{name}", required=True)
        return sub

    for run in (ingest, stations):
        sub = stage(run, "trips", "out")
        sub.add_argument("--csv", action="store_true", help="extracted CSV files, no archives")
        if run is ingest:
            sub.add_argument("--allow-unreadable", action="store_true", help="go on where times cannot be read")
    sub = stage(dataset, "trips", "out")
    sub.add_argument("--cutoff", type=date.fromisoformat, required=True)
    sub.add_argument("--top-n", type=int, default=25)
    sub = stage(weather, "response", "out")
    sub.add_argument("--day-ahead", action="store_true", help="variables of the day-ahead forecast")
    sub.add_argument("--first", type=datetime.fromisoformat, required=True)
    sub.add_argument("--last", type=datetime.fromisoformat, required=True)
    stage(features, "pickups", "weather", "out")
    stage(baseline, "pickups").add_argument("--test-days", type=int, default=7)
    for sub in (stage(explore, "pickups", "weather", "out"), stage(neighborhoods, "pickups", "stations", "polygons", "out")):
        sub.add_argument("--months", nargs=2, metavar=("FIRST", "LAST"), help="months to read, as YYYY-MM")
    stage(errors, "predictions", "features", "out").add_argument("--model", default="gradient_boosting_weather")
    for run in (evaluate, importance):
        sub = stage(run, "features", "out")
        sub.add_argument("--test-start", type=date.fromisoformat, required=True)
        sub.add_argument("--test-end", type=date.fromisoformat, required=True)
        sub.add_argument("--trees", type=int, default=200)
        if run is evaluate:
            sub.add_argument("--folds", type=date.fromisoformat, nargs="+", required=True)
            sub.add_argument("--fold-days", type=int, default=7)
            sub.add_argument("--test-rows", type=int, required=True)
        else:
            sub.add_argument("--repeats", type=int, default=10)
    return parser


def main(arguments: Sequence[str] | None = None) -> None:
    args = _parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"hourgrid-{args.stage}").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
