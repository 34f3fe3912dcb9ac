"""Lags and shifted rolling statistics of a dense hourly series.

Windows look back a fixed number of rows, which on a dense grid is a fixed number of hours. A row that does not
follow the one before it by exactly an hour fails the job; the check shares the windows' shuffle and sort. Where blocks
meet, a row may have no earlier one beside it, so first and last hours of the blocks are compared beforehand, which
reads keys and times once more and shuffles a row per block. A window
partition per key alone would put a key's whole history into one task and leave no more tasks than
there are keys. Each history is therefore cut into blocks of days; the tail of a block that the next
one looks back on is copied into it, so every row still sees exactly the rows it would see in the whole
history and a task never holds more than one block.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hourgrid.operators.quality import enforce, require_empty
from hourgrid.schemas import LAGS, ROLLING_HOURS, ROLLING_SHIFT

BLOCK_DAYS = 84
RUNNING = ("_count", "_sum", "_squares")


def _day(ts: str) -> Column:
    return F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date"))


def _own_block(ts: str, block_days: int) -> Column:
    return F.floor(_day(ts) / block_days).cast("int")


def gaps_between_blocks(df: DataFrame, key: str, ts: str = "timestamp", block_days: int = BLOCK_DAYS) -> DataFrame:
    """Series whose first hour in a block does not follow their last hour before it: ``key, last_hour, next_hour``."""
    ends = df.groupBy(key, _own_block(ts, block_days).alias("_block")).agg(F.min(ts).alias("next_hour"), F.max(ts).alias("_last"))
    by_block = Window.partitionBy(key).orderBy("_block")
    joined = ends.withColumn("last_hour", F.lag("_last").over(by_block))
    return joined.where(F.col("next_hour") != F.col("last_hour") + F.expr("interval 1 hour")).select(key, "last_hour", "next_hour")


def _cut_into_blocks(df: DataFrame, ts: str, reach_hours: int, block_days: int) -> DataFrame:
    reach_days = ceil(reach_hours / 24)
    if reach_days >= block_days:
        raise ValueError(f"blocks of {block_days} days cannot look back {reach_hours} hours")
    day, own = _day(ts), _own_block(ts, block_days)
    is_tail = F.pmod(day, F.lit(block_days)) >= block_days - reach_days
    blocks = F.when(is_tail, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_own", own).withColumn("_block", F.explode(blocks))


def add_history(
    df: DataFrame,
    key: str,
    value: str,
    ts: str = "timestamp",
    lags: Sequence[int] = LAGS,
    rolling_hours: int | None = ROLLING_HOURS,
    rolling_shift: int = ROLLING_SHIFT,
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """Add ``lag_k`` for every k, and mean and sample deviation over ``rolling_hours`` rows of which the
    last is ``rolling_shift`` rows back. A rolling value is null until its frame is full.

    ``value`` is an integer column. All windows share one partitioning and order: one shuffle, one sort.
    """
    reach = max([*lags, (rolling_shift + rolling_hours - 1) if rolling_hours else 0])
    blocked = _cut_into_blocks(df, ts, reach, block_days)
    require_empty(gaps_between_blocks(df, key, ts, block_days), f"series are not dense, by {key}")
    ordered = Window.partitionBy(key, "_block").orderBy(ts)
    columns = {f"lag_{k}": F.lag(value, k).over(ordered) for k in lags}
    if rolling_hours:
        blocked = blocked.withColumns(_running(ordered, value))
        columns |= _in_frame(ordered, rolling_hours, rolling_shift)
    # below a window, where no filter on the result can be mixed with the check
    blocked = blocked.withColumn("_before", F.lag(ts, 1).over(ordered))
    follows = F.coalesce(F.col("_before") == F.col(ts) - F.expr("interval 1 hour"), F.lit(True))
    gap = F.concat(F.lit("series "), F.col(key).cast("string"), F.lit(" is not dense, "), F.col(ts).cast("string"), F.lit(" follows "), F.col("_before").cast("string"))
    looked_back = enforce(blocked, follows, gap).drop("_before").withColumns(columns).where("_own = _block").drop("_own", "_block")
    if not rolling_hours:
        return looked_back
    return looked_back.withColumns(_statistics(rolling_hours)).drop(*RUNNING)


def _running(ordered: WindowSpec, value: str) -> dict[str, Column]:
    """Running count, sum and sum of squares; decimals keep the squares exact."""
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wide = F.col(value).cast("long")
    square = wide.cast("decimal(19,0)") * wide.cast("decimal(10,0)")
    return {
        "_count": F.count(value).over(upto),
        "_sum": F.sum(wide).over(upto),
        "_squares": F.sum(square.cast("decimal(28,0)")).over(upto),
    }


def _in_frame(ordered: WindowSpec, hours: int, shift: int) -> dict[str, Column]:
    """Totals of the frame as differences of two running totals; the cost does not depend on the frame."""

    def difference(running: str) -> Column:
        last = F.lag(running, shift).over(ordered)
        before = F.lag(running, shift + hours).over(ordered)
        return last - F.coalesce(before, F.lit(0))

    return {name: difference(name) for name in RUNNING}


def _statistics(hours: int) -> dict[str, Column]:
    """Integer arithmetic gives a constant frame a deviation of exactly zero."""
    full = F.col("_count") == hours
    total = F.col("_sum").cast("decimal(19,0)")
    spread = F.col("_squares") * hours - total * total
    return {
        f"rolling_mean_{hours}": F.when(full, F.col("_sum") / F.lit(hours)),
        f"rolling_std_{hours}": F.when(full, F.sqrt(spread.cast("double") / F.lit(hours * (hours - 1)))),
    }
