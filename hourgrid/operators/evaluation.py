"""Holdouts, folds, and forecast metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.functions import errors
from hourgrid.functions.time import naive
from hourgrid.operators.counts import between_times
from hourgrid.operators.quality import DataQualityError, require_rows


def trailing_start(df: DataFrame, days: int, ts: str = "timestamp") -> date:
    """The day that begins the last ``days`` calendar days of the data.

    One value is read now, so that the split is a literal and the scan skips what lies outside.
    """
    latest = df.agg(F.to_date(F.max(ts))).first()[0]
    if latest is None:
        raise DataQualityError("no rows to hold out")
    return latest - timedelta(days=days - 1)


def trailing_split(df: DataFrame, days: int, ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Rows before, and rows of, the last ``days`` calendar days of the data."""
    start = naive(trailing_start(df, days, ts))
    return df.where(F.col(ts) < start), df.where(F.col(ts) >= start)


def fixed_test(
    df: DataFrame, start: date, end: date, expected_rows: int | None = None, ts: str = "timestamp"
) -> DataFrame:
    """The locked test period ``[start, end)``, optionally with an exact row count."""
    test = between_times(df, ts, naive(start), naive(end))
    if expected_rows is not None:
        require_rows(test, expected_rows, "final test")
    return test


def metrics_by_model(
    df: DataFrame, predictions: Mapping[str, str], actual: str = "pickups", keys: Sequence[str] = ()
) -> DataFrame:
    """MAE and RMSE of every prediction column, one row per model (and key).

    All models come out of one aggregation over the rows as they are; only its result, one row per
    key, is unfolded into a row per model.
    """
    y = F.col(actual)
    aggregates = []
    for i, column in enumerate(predictions.values()):
        aggregates += [errors.mae(y, F.col(column)).alias(f"_mae{i}"), errors.rmse(y, F.col(column)).alias(f"_rmse{i}")]
    wide = df.groupBy(*keys).agg(*aggregates)
    rows = [
        F.struct(F.lit(label).alias("model"), F.col(f"_mae{i}").alias("MAE"), F.col(f"_rmse{i}").alias("RMSE"))
        for i, label in enumerate(predictions)
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))


def assign_folds(
    df: DataFrame, starts: Sequence[date], days: int, ts: str = "timestamp", out: str = "validation_week"
) -> DataFrame:
    """Each row once per validation period it falls in; periods may overlap.

    The few periods are literals, so the range condition is a projection and not a nested-loop join.
    """
    stamp = F.col(ts)

    def inside(start: date) -> Column:
        return (stamp >= naive(start)) & (stamp < naive(start + timedelta(days=days)))

    any_fold = F.lit(False)
    for start in starts:
        any_fold = any_fold | inside(start)
    matching = F.array_compact(F.array(*[F.when(inside(s), F.lit(s)) for s in starts]))
    return df.where(any_fold).select(F.explode(matching).alias(out), "*")


def summarize_folds(results: DataFrame) -> DataFrame:
    """Mean and sample deviation of both metrics over the folds, per model."""
    return results.groupBy("model").agg(
        F.avg("MAE").alias("mean_MAE"),
        F.stddev_samp("MAE").alias("std_MAE"),
        F.avg("RMSE").alias("mean_RMSE"),
        F.stddev_samp("RMSE").alias("std_RMSE"),
    )


def best_other(summary: DataFrame, excluded: str) -> DataFrame:
    """The model with the lowest mean MAE apart from ``excluded``; equal errors give the lower name."""
    others = summary.where(F.col("model") != excluded)
    best = others.agg(F.min(F.struct("mean_MAE", "model")).alias("b"))
    return best.select(F.col("b.model").alias("best_model"), F.col("b.mean_MAE").alias("best_MAE"))


def improvement_over_best(summary: DataFrame, candidate: str) -> DataFrame:
    """How much of the best other model's mean MAE the candidate removes.

    ``summary`` has one row per model and is read several times; hand in a written one.
    """
    best = best_other(summary, candidate)
    return summary.where(F.col("model") == candidate).select(
        "model",
        "mean_MAE",
        best.select("best_model").scalar().alias("best_model"),
        best.select("best_MAE").scalar().alias("best_MAE"),
        errors.improvement(best.select("best_MAE").scalar(), F.col("mean_MAE")).alias("improvement"),
    )


def improvement_by_model(summary: DataFrame, reference: str) -> DataFrame:
    """Share of the reference model's errors that every other model removes; ``summary`` as above."""
    base = summary.where(F.col("model") == reference)
    base_mae = base.select("mean_MAE").scalar()
    base_rmse = base.select("mean_RMSE").scalar()
    return summary.where(F.col("model") != reference).select(
        "model",
        errors.improvement(base_mae, F.col("mean_MAE")).alias("MAE_improvement"),
        errors.improvement(base_rmse, F.col("mean_RMSE")).alias("RMSE_improvement"),
    )
