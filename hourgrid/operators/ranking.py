"""Canonical labels and top-N selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.operators.quality import DataQualityError


def canonical_label(df: DataFrame, key: str, label: str, weight: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """For every key the label with the highest weight; equal weights give the lower label.

    ``df`` has one row per (key, label). The minimum of ``(-weight, label)`` is a plain aggregate with
    a map-side combine: nothing is sorted, and a key with very many labels is no larger than others.
    """
    ordered = F.struct((-F.col(weight)).alias("_w"), F.col(label).alias(label), *[F.col(c) for c in carry])
    best = df.groupBy(key).agg(F.min(ordered).alias("_best"))
    return best.select(key, f"_best.{label}", *[f"_best.{c}" for c in carry])


def top_entities(
    hourly: DataFrame, key: str, value: str, n: int, ts: str = "timestamp", cutoff: Column | None = None
) -> DataFrame:
    """The ``n`` keys with the highest total before ``cutoff``; equal totals favour the lower key.

    Only rows before the cutoff count, so demand of the evaluation period cannot choose its own stations.
    """
    history = hourly if cutoff is None else hourly.where(F.col(ts) < cutoff)
    totals = history.groupBy(key).agg(F.sum(value).alias("total"))
    return totals.orderBy(F.desc("total"), F.asc(key)).limit(n)


def require_selection(selected: DataFrame, n: int) -> None:
    """Raise when no data lies before the cutoff, or fewer than ``n`` keys do."""
    found = selected.count()
    if found == 0:
        raise DataQualityError("no data before the selection cutoff")
    if found < n:
        raise DataQualityError(f"only {found} keys have data before the cutoff, {n} are wanted")
