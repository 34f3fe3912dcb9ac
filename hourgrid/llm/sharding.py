"""Sharding by sampled splitters: ranges of a row key, cut at quantiles of a size-weighted sample.

A row's key is a hash of its text followed by a hash of the whole row, so equal texts lie side by side, while a text
that fills a third of the table still has many keys. Rows are drawn for the sample with a chance in proportion to
their size; quantiles of the drawn keys split the keys into ranges of about equal size. The ranges are then measured
in full. One that holds over twice its share is divided again, by a sample of its own, until each is small or is a
single key. The ranges' exact totals say which bytes lie before each of them, and within a range a running total gives
each row its place: a row belongs to the shard in which the middle of its bytes falls. Shards differ by the size of
one row at most, and equal texts share a shard unless a shard ends among them.

A null text has no bytes, and a null id is an id like any other; repeated rows get places of their own; an empty table
gives an empty result. An old column with the name of a new one gets ``_before`` added to its name, as often as that takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.session import materialize

SHARDS = 40
OVERHEAD = 16
#: Bytes and rows of a range on large inputs, and the least number of ranges for each shuffle partition on small ones.
RANGE_BYTES = 64 << 20
RANGE_ROWS = 100_000
RANGES_PER_PARTITION = 4
#: Drawn keys for each range.
DRAWS = 64
TEXT_BITS = 40
ADDED = ("size", "text_crc32", "shard", "slot")


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def row_key(docs: DataFrame, text: str) -> Column:
    """63 bits: of the text's hash, then of the whole row's."""
    columns = [docs[f"`{c}`"] for c in docs.columns]
    whole = F.shiftrightunsigned(F.xxhash64(*columns), 64 - (63 - TEXT_BITS))
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(docs[f"`{text}`"]), 64 - TEXT_BITS), 63 - TEXT_BITS).bitwiseOR(whole)


def _drawn(rows: DataFrame, per_row: Column, salt: int) -> DataFrame:
    """``key, weight`` of rows drawn with the chance ``size * per_row``, decided by a hash."""
    chance = F.least(F.lit(1.0), F.col("size") * per_row)
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "key"), 11) / F.lit(float(1 << 53))
    return rows.where(uniform < chance).select("key", (F.col("size") / chance).alias("weight"))


def _quantiles(drawn: pd.DataFrame, parts: int) -> set[int]:
    """Keys that cut the weight into about equal parts; a range holds the keys up to its splitter.

    A key that covers several quantiles gets a range of its own.
    """
    drawn = drawn.sort_values("key")
    total = drawn["weight"].cumsum().to_numpy()
    if not len(total):
        return set()
    at = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)
    keys, times = np.unique(drawn["key"].to_numpy()[np.minimum(at, len(total) - 1)], return_counts=True)
    return {*keys.tolist()} | {*(keys[times > 1] - 1).tolist()}


def _range_of(splitters: list[int]):
    edges = np.array(splitters, np.int64)

    @F.pandas_udf("long")
    def place(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for key in keys:
            yield pd.Series(np.searchsorted(edges, key.to_numpy()), dtype="int64")

    return place("key")


def splitters_of(rows: DataFrame, least_ranges: int) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Splitters for ``rows`` (``key, size``), and each range's exact bytes and rows."""
    total, count = rows.agg(F.sum("size"), F.count("*")).collect()[0]
    if not count:
        return [], {}
    parts = max(least_ranges, -(-total // RANGE_BYTES), -(-count // RANGE_ROWS))
    bytes_each, rows_each = max(total / parts, 1 << 20), max(count / parts, 500)
    splitters = sorted(_quantiles(_drawn(rows, F.lit(DRAWS * parts / total), 0).toPandas(), parts))
    salt = 0
    while True:
        measured = rows.withColumn("range", _range_of(splitters)).groupBy("range")
        found = measured.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        pieces = {r["range"]: int(max(r["bytes"] / bytes_each, r["n"] / rows_each)) for r in found if r["low"] < r["high"]}
        full = [r for r in found if pieces.get(r["range"], 0) > 4]
        if not full:
            return splitters, {r["range"]: (r["bytes"], r["n"]) for r in found}
        salt += 1
        finer = {*splitters}
        for r in full:
            inside = rows.where(F.col("key").between(r["low"], r["high"]))
            cuts = _quantiles(_drawn(inside, F.lit(DRAWS * pieces[r["range"]] / r["bytes"]), salt).toPandas(), pieces[r["range"]])
            # a range whose rows are many and light, or whose draws were few, is halved by key
            finer |= {c for c in cuts if r["low"] <= c < r["high"]} or {(r["low"] + r["high"]) // 2}
        splitters = sorted(finer)


def free_names(columns: list[str]) -> dict[str, str]:
    """A name for each column that none of the new columns has."""
    names, used = {}, {*columns, *ADDED}
    for column in columns:
        name = column
        while name in ADDED or name != column and name in used:
            name += "_before"
        used.add(name)
        names[column] = name
    return names


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``size, text_crc32, shard, slot``; slots count from 0 in each shard."""
    kept = free_names(docs.columns if carry is None else carry)
    spark = docs.sparkSession
    body = docs[f"`{text}`"]
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"].alias(name) for c, name in kept.items()]).alias("row"), row_key(docs, text).alias("key"), row_size(body).alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    keys = materialize(rows.select("key", "size"), "keys")
    splitters, measured = splitters_of(keys, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = sum(size for size, _ in measured.values())
    offsets, size, count = [], 0, 0
    for place in sorted(measured):
        offsets.append((place, size, count))
        size, count = size + measured[place][0], count + measured[place][1]
    before = spark.createDataFrame(offsets, "range long, bytes_before long, rows_before long")

    def placed(of: DataFrame, *ties: str) -> DataFrame:
        order = Window.partitionBy("range").orderBy("key", "size", *ties)
        end = F.col("bytes_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
        found = of.withColumn("range", _range_of(splitters)).join(before, "range")
        found = found.withColumns({"end": end, "place": F.col("rows_before") + F.row_number().over(order) - 1})
        # twice the middle of the row's bytes, so that it is a whole number
        return found.withColumn("shard", F.least(F.expr(f"int((2 * end - size) * {shards} div {max(2 * total, 1)})"), F.lit(shards - 1)))

    heads = {r["shard"]: r["head"] for r in placed(keys).groupBy("shard").agg(F.min("place").alias("head")).collect()}
    head = F.element_at(F.array(*[F.lit(heads.get(s, 0)).cast("long") for s in range(shards)]), F.col("shard") + 1)
    return placed(rows, "text_crc32").select("row.*", "size", "text_crc32", "shard", (F.col("place") - head).alias("slot"))
