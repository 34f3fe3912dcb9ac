"""Equi-joins with a checked key contract.

No join carries a broadcast hint. Spark broadcasts a side when its size, measured at run time under
adaptive execution, is below ``spark.sql.autoBroadcastJoinThreshold``, and shuffles both otherwise, so a
dimension that outgrows memory changes the plan instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hourgrid.functions.time import hour_calendar
from hourgrid.operators.quality import DataQualityError, guard_not_null, require_no_nulls, unique_on
from hourgrid.schemas import WEATHER_MEASURES

CONTRACTS = ("many_to_one", "one_to_one")


def join_checked(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left", validate: str = "many_to_one"
) -> DataFrame:
    """Join on ``on`` and fail the job if a side that must be unique on it is not."""
    if validate not in CONTRACTS:
        raise ValueError(f"validate must be one of {CONTRACTS}")
    keys = [on] if isinstance(on, str) else list(on)
    if validate == "one_to_one":
        left = unique_on(left, keys, "left side")
    return left.join(unique_on(right, keys, "right side"), keys, how)


@dataclass(frozen=True)
class JoinCounts:
    """Rows before and after a join and those without a partner, counted by the job that reads the join."""

    before: Observation = field(default_factory=Observation)
    after: Observation = field(default_factory=Observation)

    def get(self) -> dict[str, int]:
        """Waits for the first job."""
        return {**self.before.get, **self.after.get}

    def require_unchanged(self, label: str) -> None:
        counts = self.get()
        if counts["rows_before"] != counts["rows_after"]:
            raise DataQualityError(f"{label}: {counts['rows_before']:,} rows became {counts['rows_after']:,}")


def join_counted(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], looked_up: str, validate: str = "many_to_one"
) -> tuple[DataFrame, JoinCounts]:
    """A checked left join that counts itself without a scan of its own; ``looked_up`` is a column that partners always have."""
    counts = JoinCounts()
    seen = left.observe(counts.before, F.count(F.lit(1)).alias("rows_before"))
    joined = join_checked(seen, right, on, "left", validate)
    unmatched = F.count_if(F.col(looked_up).isNull()).alias("unmatched")
    return joined.observe(counts.after, F.count(F.lit(1)).alias("rows_after"), unmatched), counts


def lookup(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Attach the columns of ``names``; a key that is absent there gets nulls."""
    return df.join(names, key, "left")


def keep_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``listed``, which stays a DataFrame."""
    return df.join(listed.select(key), key, "left_semi")


def add_weather(facts: DataFrame, weather: DataFrame, ts: str = "timestamp", seen: Observation | None = None) -> DataFrame:
    """One citywide weather row for every fact row, and whether it rained or snowed.

    ``seen`` counts the facts (``rows``) and those ``without_weather``, also where a later step leaves them out.
    """
    joined = join_checked(facts, weather.select(ts, *WEATHER_MEASURES), ts)
    if seen is not None:
        lacking = F.lit(False)
        for measure in WEATHER_MEASURES:
            lacking = lacking | F.col(measure).isNull()
        joined = joined.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(lacking).alias("without_weather"))
    complete = guard_not_null(joined, WEATHER_MEASURES, ts, "weather join")
    return complete.withColumn("is_precipitating", (F.col("precipitation_mm") > 0).cast("tinyint"))


def require_weather(facts: DataFrame, weather: DataFrame, ts: str = "timestamp") -> None:
    """Raise, with the number of hours per column, when an hour from the first to the last fact has no complete weather.

    The facts are an hourly grid: their first and last hour say which hours there are, so nothing of them is shuffled.
    """
    first, last = facts.agg(F.min(ts), F.max(ts)).first()
    if first is not None:
        hours = hour_calendar(facts.sparkSession, first, last, ts).join(weather, ts, "left")
        require_no_nulls(hours, WEATHER_MEASURES, f"hours from {first} to {last} lack weather")
