"""The staging folder, and the physical plans the operators promise."""

import re
from datetime import date
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

import hourgrid.session as session
from hourgrid.functions.time import naive
from hourgrid.operators.counts import between_times, hourly_counts
from hourgrid.operators.evaluation import assign_folds, metrics_by_model
from hourgrid.operators.grid import dense_grid
from hourgrid.operators.history import add_history
from hourgrid.operators.joins import join_checked
from hourgrid.operators.profile import describe_exact
from hourgrid.operators.ranking import canonical_label, top_entities
from hourgrid.operators.reports import monthly_activity
from hourgrid.plans.features import build_features
from hourgrid.schemas import BASELINES
from tests.helpers import dense, weather_for

SF_DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


class FakeSession:
    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}


def test_shared_folder_comes_from_the_session():
    assert session.shared_folder(FakeSession(spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(ValueError, match="all executors can reach"):
        session.shared_folder(FakeSession(spark_master="yarn"))


def test_local_session_gets_one_folder():
    fake = FakeSession(spark_master="local[2]", spark_app_id="app-1")
    assert session.shared_folder(fake) == session.shared_folder(fake)


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).cast("tinyint").alias("odd"), naive("2026-03-08T02:30:00").alias("t"))
    staged = session.materialize(df, "test")
    assert staged.dtypes == df.dtypes and sorted(staged.collect()) == sorted(df.collect())


def test_counts_read_three_columns_and_combine_before_the_shuffle(spark):
    trips = spark.read.parquet(f"{SF_DIR}/events.parquet").withColumnsRenamed({"ts": "started_at", "user_id": "start_station_id", "event_type": "start_station_name"})
    text = plan(hourly_counts(between_times(trips, "started_at", naive("2024-01-05"), naive("2024-01-06"))))
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>", text)
    assert "GreaterThanOrEqual(ts" in text and text.count("Exchange") == 1 and "partial_count" in text


def test_history_shares_one_shuffle_and_one_sort(spark):
    df, _ = dense(spark, 2, 24)
    text = plan(add_history(df, "station_id", "pickups"))
    assert text.count("Exchange hashpartitioning") == 1 and len(re.findall(r"[+-] Sort ", text)) == 1


def test_no_nested_loops_or_unpartitioned_windows(spark):
    df, _ = dense(spark, 2, 24 * 20)
    staged = session.materialize(df, "plans")
    members = staged.select("station_id").distinct()
    frames = [
        dense_grid(staged, members, "station_id", "pickups"),
        metrics_by_model(assign_folds(add_history(staged, "station_id", "pickups"), [date(2024, 1, 15)], 3), BASELINES, keys=["validation_week"]),
        canonical_label(staged.groupBy("station_id", "station_name").agg(F.sum("pickups").alias("n")), "station_id", "station_name", "n"),
    ]
    for text in map(plan, frames):
        assert "NestedLoop" not in text and "Cartesian" not in text
        windows = [line for line in text.splitlines() if "Window [" in line]
        assert all("[station_id#" in line and "_block#" in line for line in windows)


def test_grid_rows_are_not_shuffled(spark):
    df, _ = dense(spark, 2, 24 * 20)
    staged = session.materialize(df, "plans")
    members = staged.select("station_id").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grid = plan(dense_grid(staged, members, "station_id", "pickups"))
        months = plan(monthly_activity(staged, members))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # operators above the one that unfolds hours come first
    assert "Join" in grid and "Exchange" not in grid.split("Generate explode")[0]
    assert "Exchange" not in months.split("partial_sum(pickups")[1].split("FileScan")[0]


def test_selection_is_a_top_k_and_not_a_sort(spark):
    df, _ = dense(spark, 2, 24)
    assert "TakeOrderedAndProject" in plan(top_entities(df, "station_id", "pickups", 1))


def test_no_local_checkpoint_and_no_broadcast_hints():
    for path in [*ROOT.glob("hourgrid/**/*.py"), *ROOT.glob("queries/*.py")]:
        source = path.read_text()
        assert "localCheckpoint(" not in source and "broadcast(" not in source and "crossJoin(" not in source, path


def test_checked_join_adds_no_shuffle_of_its_own(spark):
    left, _ = dense(spark, 2, 24)
    right = left.groupBy("station_id").agg(F.max("station_name").alias("other"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = plan(join_checked(left, right, "station_id"))
        plain = plan(left.join(right, "station_id", "left"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert joined.count("Exchange") == plain.count("Exchange") == 2


def test_features_scan_the_facts_once(spark):
    facts, _ = dense(spark, 2, 400)
    facts, weather = session.materialize(facts, "facts"), session.materialize(weather_for(spark, "2024-01-01", 400), "weather")
    text = plan(build_features(facts, weather, Observation()))
    assert text.count("FileScan parquet") == 2


def test_quartiles_rank_no_window_in_one_task(spark, monkeypatch):
    plans = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: plans.append(plan(df)) or collect(df))
    values = [float(i % 700) for i in range(3000)]
    row = describe_exact(spark.createDataFrame([(v,) for v in values], "pickups double")).first()
    assert row["p50"] == np.median(values)
    windows = [text for text in plans if "Window [" in text]
    assert windows and all("SinglePartition" not in text for text in windows)
