"""Baseline evaluation, expanding-window backtest and locked final test."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.time import naive
from hourgrid.models.configurations import CONFIGURATIONS, predict_all, train_together
from hourgrid.operators.evaluation import assign_folds, fixed_test, metrics_by_model, trailing_start
from hourgrid.operators.history import add_history
from hourgrid.schemas import BASELINES


def baseline_predictions(pickups: DataFrame) -> DataFrame:
    return add_history(pickups, "station_id", "pickups", lags=(24, 168), rolling_hours=None)


def evaluate_baselines(pickups: DataFrame, test_days: int = 7) -> DataFrame:
    """Both seasonal baselines on the last ``test_days`` days, best first.

    Only the test days and the week they look back on reach the window.
    """
    start = trailing_start(pickups, test_days)
    recent = pickups.where(F.col("timestamp") >= naive(start - timedelta(days=7)))
    test = baseline_predictions(recent).where(F.col("timestamp") >= naive(start)).na.drop(subset=list(BASELINES.values()))
    return metrics_by_model(test, BASELINES).orderBy("MAE", "model")


def backtest_baselines(features: DataFrame, starts: Sequence[date], days: int = 7) -> DataFrame:
    """Both baselines on every validation period, all periods in one pass."""
    return metrics_by_model(assign_folds(features, starts, days), BASELINES, keys=["validation_week"])


def _before(start: date) -> Column:
    return F.col("timestamp") < naive(start)


def _columns(configurations: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Label and prediction column of the baselines and of every configuration."""
    return {**BASELINES, **{name: name for name in configurations}}


def run_backtest(
    features: DataFrame,
    starts: Sequence[date],
    days: int = 7,
    configurations: Mapping[str, Sequence[str]] = CONFIGURATIONS,
    **boosting,
) -> DataFrame:
    """Train on everything before each start, score the ``days`` after it: metrics per fold and model."""
    models = train_together(features, {s: _before(s) for s in starts}, configurations, **boosting)
    folds = []
    for start in starts:
        validation = fixed_test(features, start, start + timedelta(days=days))
        scored = predict_all(validation, [models[start, name] for name in configurations])
        metrics = metrics_by_model(scored, _columns(configurations))
        folds.append(metrics.select(F.lit(start).alias("validation_week"), "*"))
    return reduce(DataFrame.unionByName, folds)


def run_final_test(
    features: DataFrame,
    start: date,
    end: date,
    expected_rows: int,
    configurations: Mapping[str, Sequence[str]] = CONFIGURATIONS,
    **boosting,
) -> tuple[DataFrame, DataFrame]:
    """Metrics of models and baselines on the locked period, and the scored rows behind them."""
    test = fixed_test(features, start, end, expected_rows)
    models = train_together(features, {start: _before(start)}, configurations, **boosting)
    scored = predict_all(test, models.values())
    return metrics_by_model(scored, _columns(configurations)).orderBy("MAE", "model"), scored
