"""Mixing sources to target weights by hash thresholds, in DataFrame operations only.

Sizes are summed by source and by ranges of a keyed row hash. For each source that histogram gives the range in which
the running total reaches the budget; only that range is refined, level by level, until the threshold is exact. A row
is taken if its hash is at most its source's threshold. Thresholds are nested: a larger budget takes the same rows and
more. No level sorts rows, and each sends at most sources x ``FANOUT`` partial sums per task.

Budgets: every source gets its weight's share of ``budget`` times all sizes; a share above ``most`` times the source's
size stops there, and what is over goes to the others by weight, until none is above. A source whose target is above
its size is taken whole as often as that fits, and the threshold decides about one more copy.

A null or empty text has size 0; a null source is a source of its own, last in order; rows equal in id and text share
a hash, so they are taken together; sources without any words have target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.llm.staging import word_count
from hourgrid.session import materialize

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2.0
#: Each level tells this many ranges of the hash apart; 15 hexadecimal digits in 5 levels are exact.
LEVEL_DIGITS = 3
LEVELS = 5
FANOUT = 16**LEVEL_DIGITS


def row_hash(doc_id: Column, text: Column, key: str) -> Column:
    """60 bits as a long; the same in any engine that has md5."""
    said = F.concat_ws("|", F.lit(key), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(said), 1, LEVELS * LEVEL_DIGITS), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``source`` with its position from 0 in order of code points, null last; numbered per range, not in one task."""
    ordered = materialize(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = ordered.groupBy("part").agg(F.count("*").alias("n")).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("counts"))
    counts = counts.collect()[0]["counts"] or {}
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    offset = F.lit(0)
    if before:
        offset = F.create_map(*[F.lit(x) for item in before.items() for x in item])[F.col("part")]
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ordered.withColumn("position", within - 1 + offset)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: shares by weight, none above ``most`` times its source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    rows = materialize(ranked(totals).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "weights")
    everything = rows.agg(F.sum("source_size")).collect()[0][0] or 0
    level = 0.0
    while True:  # the level only rises, and each round stops at least one source more
        open_ = F.col("weight") * level < F.col("cap")
        capped, weighed = rows.agg(F.sum(F.when(~open_, F.col("cap"))), F.sum(F.when(open_, F.col("weight")))).collect()[0]
        if not weighed:
            break
        higher = (budget * everything - (capped or 0.0)) / weighed
        if higher <= level:
            break
        level = higher
    return rows.select("source", "source_size", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


def thresholds(hashed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, source_size, target, whole, threshold``: copies of every row, and the hash up to which rows get one more.

    ``hashed`` has ``source, size, hash``. The rows up to the threshold are those whose total is nearest to the budget,
    the fewer on a tie.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = targets.withColumn("whole", F.floor(ratio).cast("long")).withColumns(
        {"budget": F.col("target") - F.col("whole") * F.col("source_size"), "prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long")}
    )
    state = materialize(state, "budgets")
    bits = 4 * LEVEL_DIGITS
    for level in range(LEVELS):
        shift = bits * (LEVELS - 1 - level)
        bucket = F.shiftright("hash", shift)
        chosen = state.select(F.col("source").alias("s"), "budget", "prefix", "below")
        inside = hashed if level == 0 else hashed.join(chosen, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + bits) == F.col("prefix")))
        histogram = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        filled = histogram.withColumn("up_to", running).join(chosen, F.col("source").eqNullSafe(F.col("s")))
        # the first range whose end passes the budget holds the threshold; where none does, every row is below it
        passed = F.col("below") + F.col("up_to") > F.col("budget")
        found = filled.groupBy("source").agg(
            F.min(F.when(passed, F.struct("bucket", "up_to", "size"))).alias("edge"),
            F.max(F.when(~passed, F.struct("bucket", "up_to"))).alias("last"),
        )
        joined = state.join(found.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        after = F.col("below") + F.coalesce(F.col("edge.up_to") - F.col("edge.size"), F.col("last.up_to"), F.lit(0))
        if level < LEVELS - 1:
            columns = {"prefix": F.coalesce(F.col("edge.bucket"), F.lit(1 << 62)), "below": after}
        else:
            nearer = F.col("edge").isNotNull() & (F.col("below") + F.col("edge.up_to") - F.col("budget") < F.col("budget") - after)
            columns = {"prefix": F.when(nearer, F.col("edge.bucket")).otherwise(F.coalesce(F.col("edge.bucket") - 1, F.col("prefix"))), "below": after}
        state = materialize(joined.withColumns(columns).drop("edge", "last"), "budgets")
    return state.select("source", "source_size", "target", "whole", F.when(F.col("budget") > 0, F.col("prefix")).otherwise(F.lit(-1)).alias("threshold"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    most: float = MOST,
    key: str = "mix",
) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with ``size, source_size, target, copies``; ``copies`` may be 0."""
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        row_hash(F.col(doc_id), F.col(text), key).alias("hash"),
    )
    hashed = materialize(rows.select("source", "size", "hash"), "hashed")
    cuts = thresholds(hashed, source_targets(hashed, weights, budget, most)).withColumnRenamed("source", "s")
    copies = F.col("whole") + F.when(F.col("hash") <= F.col("threshold"), 1).otherwise(0)
    return rows.join(cuts, F.col("source").eqNullSafe(F.col("s"))).select("row", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns it had."""
    taken = mix(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")
