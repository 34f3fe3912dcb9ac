from datetime import timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hourgrid.functions.time import naive
from hourgrid.operators.history import add_history
from hourgrid.operators.quality import DataQualityError
from hourgrid.plans.features import build_features
from hourgrid.schemas import HISTORY_FEATURES, LAGS
from tests.helpers import dense, frame, hours, weather_for


def expected_history(pdf):
    pdf = pdf.sort_values(["station_id", "timestamp"]).reset_index(drop=True)
    by = pdf.groupby("station_id")["pickups"]
    for k in LAGS:
        pdf[f"lag_{k}"] = by.shift(k)
    shifted = by.shift(24)
    windows = shifted.groupby(pdf["station_id"]).rolling(168, min_periods=168)
    pdf["rolling_mean_168"] = windows.mean().reset_index(level=0, drop=True)
    pdf["rolling_std_168"] = windows.std().reset_index(level=0, drop=True)
    return pdf


@pytest.mark.parametrize("block_days", [15, 84, 1000])
def test_history_equals_pandas_for_any_block_length(spark, block_days):
    df, pdf = dense(spark, 2, 1100, "2023-12-20")
    got = add_history(df, "station_id", "pickups", block_days=block_days).toPandas()
    got = got.sort_values(["station_id", "timestamp"]).reset_index(drop=True)
    want = expected_history(pdf)
    assert len(got) == len(want)
    for column in HISTORY_FEATURES:
        np.testing.assert_allclose(got[column].astype(float), want[column].astype(float), atol=1e-9)


def test_block_shorter_than_the_look_back_is_refused(spark):
    df, _ = dense(spark, 1, 24)
    with pytest.raises(ValueError, match="cannot look back"):
        add_history(df, "station_id", "pickups", block_days=14)


def test_constant_window_has_no_deviation(spark):
    stamps = hours("2024-01-01", 193)
    df = frame(spark, [(t, "a", 7) for t in stamps], "timestamp timestamp_ntz, station_id string, pickups int")
    full = add_history(df, "station_id", "pickups", lags=(24,)).where("rolling_std_168 is not null").orderBy("timestamp").collect()
    assert [(r["rolling_mean_168"], r["rolling_std_168"]) for r in full] == [(7.0, 0.0)] * 2


def test_null_in_the_frame_makes_it_null(spark):
    rows = [(t, "a", None if i == 100 else 1) for i, t in enumerate(hours("2024-01-01", 400))]
    df = frame(spark, rows, "timestamp timestamp_ntz, station_id string, pickups int")
    full = add_history(df, "station_id", "pickups", lags=(24,)).where("rolling_mean_168 is not null")
    first = full.agg(F.min("timestamp")).first()[0]
    assert first == rows[101 + 191][0]


def test_large_counts_stay_exact(spark):
    big = [2_000_000_000 - (i % 2) for i in range(192)]
    df = frame(spark, [(t, "a", v) for t, v in zip(hours("2024-01-01", 192), big)], "timestamp timestamp_ntz, station_id string, pickups int")
    last = add_history(df, "station_id", "pickups", lags=(24,)).orderBy(F.desc("timestamp")).first()
    assert last["rolling_std_168"] == pytest.approx(np.std(np.array(big[:168]) - 2_000_000_000, ddof=1), rel=1e-12)


@pytest.mark.parametrize(("count", "features"), [(335, 0), (336, 0), (337, 1)])
def test_short_history(spark, count, features):
    df, _ = dense(spark, 2, count)
    assert build_features(df, weather_for(spark, "2024-01-01", count)).count() == 2 * features


def test_feature_table_shape_and_types(spark):
    df, _ = dense(spark, 3, 400)
    table = build_features(df, weather_for(spark, "2024-01-01", 400))
    assert len(table.columns) == 25 and table.count() == 3 * (400 - 336)
    assert table.na.drop().count() == table.count()
    types = dict(table.dtypes)
    assert (types["is_precipitating"], types["lag_24"], types["rolling_std_168"]) == ("tinyint", "int", "double")


def test_features_do_not_see_the_last_day(spark):
    """Changing the 23 hours before a row, or the row itself, changes none of its history features."""
    df, pdf = dense(spark, 1, 500)
    last = pdf["timestamp"].max()
    since = naive((last - timedelta(hours=23)).isoformat())
    changed = df.withColumn("pickups", F.when(F.col("timestamp") >= since, F.lit(9999)).otherwise(F.col("pickups")))

    def row(d):
        return add_history(d, "station_id", "pickups").where(F.col("timestamp") == naive(last.isoformat())).select(*HISTORY_FEATURES).first()

    assert row(df) == row(changed)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(0, 50), min_size=40, max_size=60), shift=st.integers(1, 5), window=st.integers(2, 6))
def test_any_window_and_shift(spark, values, shift, window):
    stamps = hours("2024-02-28", len(values))
    shuffled = [(t, "a", v) for t, v in zip(stamps, values)][::-1]
    df = frame(spark, shuffled, "timestamp timestamp_ntz, station_id string, pickups int")
    got = add_history(df, "station_id", "pickups", lags=(shift,), rolling_hours=window, rolling_shift=shift, block_days=2).orderBy("timestamp").collect()
    for i, r in enumerate(got):
        assert r[f"lag_{shift}"] == (values[i - shift] if i >= shift else None)
        seen = values[max(0, i - shift - window + 1) : max(0, i - shift + 1)]
        if len(seen) < window:
            assert r[f"rolling_mean_{window}"] is None
        else:
            assert r[f"rolling_mean_{window}"] == pytest.approx(np.mean(seen))
            assert r[f"rolling_std_{window}"] == pytest.approx(np.std(seen, ddof=1), abs=1e-9)


@pytest.mark.parametrize("wrong", [[0, 1, 3, 4], [0, 1, 1, 2]])
def test_a_series_with_a_gap_or_a_repeated_hour_is_refused(spark, wrong):
    stamps = hours("2024-01-01", 5)
    df = frame(spark, [(stamps[i], "a", 1) for i in wrong], "timestamp timestamp_ntz, station_id string, pickups int")
    with pytest.raises(Exception, match="series a is not dense"):
        add_history(df, "station_id", "pickups").collect()


def test_a_gap_where_blocks_meet_is_refused(spark):
    """Days 70 to 83 are missing: all that the second block of 84 days would have a copy of."""
    stamps = [t for t in hours("1970-01-01", 100 * 24) if not 70 <= (t - hours("1970-01-01", 1)[0]).days < 84]
    df = frame(spark, [(t, s, 1) for t in stamps for s in "ab"], "timestamp timestamp_ntz, station_id string, pickups int")
    with pytest.raises(DataQualityError, match="not dense.*1970-03-11 23|not dense.*1970, 3, 11, 23"):
        add_history(df, "station_id", "pickups")
    late = df.where(F.col("timestamp") >= naive("1970-03-26"))
    assert add_history(late, "station_id", "pickups").count() == late.count()
