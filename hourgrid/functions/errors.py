"""Forecast-error expressions. The sign convention is ``error = prediction - actual``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mae(actual: Column, prediction: Column) -> Column:
    return F.avg(F.abs(prediction - actual))


def rmse(actual: Column, prediction: Column) -> Column:
    error = (prediction - actual).cast("double")
    return F.sqrt(F.avg(error * error))


def clip_at_zero(prediction: Column) -> Column:
    return F.greatest(prediction, F.lit(0.0))


def relative_pct(total_error: Column, actual: Column) -> Column:
    """Percent of the actual total; null when nothing happened."""
    return F.try_divide(total_error, actual) * 100


def direction(error: Column) -> Column:
    """A miss of exactly zero counts as an underprediction."""
    return F.when(error > 0, "overprediction").otherwise("underprediction")


def gain_label(gain: Column) -> Column:
    return F.when(gain > 0, "better").otherwise("worse")


def improvement(reference: Column, candidate: Column) -> Column:
    """Share of the reference error that the candidate removes."""
    return F.try_divide(reference - candidate, reference)


def half_even(value: Column, places: int) -> Column:
    """Rounding for reports: ties go to the even digit."""
    return F.bround(value, places)
