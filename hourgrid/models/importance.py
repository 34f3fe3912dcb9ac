"""Permutation importance: how much the MAE grows when one feature is shuffled.

A shuffle is a one-to-one pairing of rows with donor rows. Both sides get a gapless position in their own
pseudo-random order; equal positions are joined. Orders are those of an md5 of the row key, which any engine
repeats. Rows are numbered inside ranges of the md5, and a table of the ranges' sizes says where each begins, so no
task sorts all rows, the positions do not depend on the number of ranges, and a rerun after a lost executor pairs
the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.errors import mae
from hourgrid.models.configurations import add_predictions
from hourgrid.session import materialize

#: Ranges of the md5, however many rows there are; the window over their sizes has one row for each.
BUCKETS = 4096
_DIGITS = 8


def with_position(rows: DataFrame, keys: Sequence[str], salt: int, buckets: int, out: str) -> DataFrame:
    """Number the rows 0, 1, 2, ... in a pseudo-random order given by ``salt``; ``keys`` are unique."""
    said = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(salt)))
    hashed = rows.withColumn("_hash", F.md5(said))
    high = F.conv(F.substring("_hash", 1, _DIGITS), 16, 10).cast("double")
    bucketed = hashed.withColumn("_bucket", F.floor(high * buckets / float(16**_DIGITS)).cast("int"))
    up_to = F.sum("_size").over(Window.orderBy("_bucket"))
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    starts = sizes.select("_bucket", (up_to - F.col("_size")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", *keys)) - 1
    numbered = bucketed.withColumn("_inside", inside).join(starts, "_bucket")
    return numbered.select(*rows.columns, (F.col("_start") + F.col("_inside")).alias(out))


def permuted_features(
    rows: DataFrame, features: Sequence[str], keys: Sequence[str], repeats: int, seed: int, buckets: int
) -> DataFrame:
    """Every row once per (feature, repeat), with that feature's value taken from the row's donor.

    ``rows`` has the keys, the features and whatever else the caller needs; all other values stay. Within
    a repeat every feature uses the same pairing.
    """
    receivers = with_position(rows, keys, seed, buckets, "_position")
    values = rows.select(*keys, *[f for f in features if f not in keys])

    def donors(repeat: int) -> DataFrame:
        shuffled = with_position(values, keys, seed + repeat, buckets, "_position")
        return shuffled.select("_position", F.lit(repeat).alias("repeat"), F.struct(*features).alias("_donor"))

    of_all_repeats = reduce(DataFrame.unionByName, map(donors, range(1, repeats + 1)))
    paired = receivers.join(of_all_repeats, "_position").drop("_position")
    unfolded = paired.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    swapped = {
        f: F.when(F.col("feature") == f, F.col(f"_donor.{f}")).otherwise(F.col(f)) for f in features
    }
    return unfolded.withColumns(swapped).drop("_donor")


def permutation_importance(
    model: PipelineModel,
    data: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = ("station_id", "timestamp"),
    label: str = "pickups",
    prediction: str = "prediction",
    repeats: int = 5,
    seed: int = 42,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Mean and population deviation, over the repeats, of the MAE increase per feature."""
    needed = list(dict.fromkeys([*keys, *features, label]))
    rows = materialize(data.select(*needed), "importance")
    y, p = F.col(label), F.col(prediction)
    base = add_predictions(rows, model).agg(mae(y, p)).scalar()
    # The keys identify a row even where a feature that is also a key has been swapped.
    shuffled = permuted_features(rows, features, keys, repeats, seed, buckets)
    scored = add_predictions(shuffled, model).groupBy("feature", "repeat")
    increases = scored.agg((mae(y, p) - base).alias("increase"))
    return increases.groupBy("feature").agg(
        F.avg("increase").alias("MAE_increase"), F.stddev_pop("increase").alias("importance_std")
    )


def top_features(importance: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` most important features, least important of them first."""
    top = importance.orderBy(F.desc("MAE_increase"), "feature").limit(n)
    return top.orderBy("MAE_increase", F.desc("feature"))
