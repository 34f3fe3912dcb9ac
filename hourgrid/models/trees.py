"""Binary trees over numeric features, and the bins their splits lie between.

Code of this module travels with the tasks, so executors need numpy, pandas and pyarrow only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A code is one byte.
MAX_BINS = 256
#: Relative accuracy of the quantiles that cut a feature with more distinct values than bins.
QUANTILE_ACCURACY = 10_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Tree:
    """Inner nodes from the root, node 0, on; a child that is negative is the leaf ``~child``.

    A row goes left if its feature is at most the threshold; what is not a number goes right.
    """

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix of features."""
        feature, threshold, children = np.array(self.feature, int), np.array(self.threshold), np.array([self.left, self.right], int)
        at = np.full(len(x), 0 if self.feature else -1)
        rows = np.flatnonzero(at == 0)
        while len(rows):
            node = at[rows]
            goes_left = x[rows, feature[node]] <= threshold[node]
            at[rows] = np.where(goes_left, children[0, node], children[1, node])
            rows = rows[at[rows] >= 0]
        return ~at

    def predictLeaf(self, vector: Vector) -> int:
        return int(self.leaf_of(vector.toArray()[None, :])[0])

    def transform(self, dataset: DataFrame, features: str = "features", leaf: str = "leaf") -> DataFrame:
        """``dataset`` with the leaf of each row's vector."""

        @F.pandas_udf("int")
        def leaf_of(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in values:
                yield pd.Series(self.leaf_of(matrix(part)), dtype="int32")

        return dataset.withColumn(leaf, leaf_of(vector_to_array(F.col(features))))

    def moved(self, positions: Sequence[int]) -> Tree:
        """The same tree where feature ``i`` is found at ``positions[i]``."""
        return Tree(tuple(positions[f] for f in self.feature), self.threshold, self.left, self.right)


def matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()) if len(values) else np.zeros((0, 0))


def bin_edges(rows: DataFrame, values: str, members: Sequence[str], max_bins: int = MAX_BINS) -> list[list[np.ndarray]]:
    """For each training set, a boolean column of ``rows``, the edges between the bins of every feature.

    ``values`` is an array of doubles. Up to ``max_bins`` distinct values have a bin each, with edges halfway between
    them; more are cut at quantiles. Two passes, with one row per feature on the driver.
    """
    each = rows.select(F.posexplode(values).alias("feature", "x"), *members).where(~F.isnan("x"))
    inside = {m: F.when(F.col(m), F.col("x")) for m in members}
    distinct = each.groupBy("feature").agg(*[F.approx_count_distinct(inside[m]).alias(m) for m in members]).collect()
    # the count is approximate; what is collected stays small all the same
    few = {m: [r["feature"] for r in distinct if r[m] <= 2 * max_bins] for m in members}
    quantiles = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])
    cuts = []
    for m in members:
        is_few = F.col("feature").isin(few[m])
        cuts.append(F.collect_set(F.when(is_few, inside[m])).alias(f"few_{m}"))
        cuts.append(F.percentile_approx(F.when(~is_few, inside[m]), quantiles, QUANTILE_ACCURACY).alias(f"many_{m}"))
    found = {r["feature"]: r for r in each.groupBy("feature").agg(*cuts).collect()}

    def edges(feature: int, member: str) -> np.ndarray:
        row = found.get(feature)
        values = np.unique(row[f"few_{member}"]) if row else np.zeros(0)
        if len(values) > max_bins:
            return np.unique(np.quantile(values, np.arange(1, max_bins) / max_bins, method="lower"))
        return (values[1:] + values[:-1]) / 2 if len(values) else np.unique(row[f"many_{member}"] or []) if row else values

    width = max(found, default=-1) + 1
    return [[edges(f, m) for f in range(width)] for m in members]


def codes_of(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many of its feature's edges lie below it."""
    codes = np.zeros(x.shape, np.uint8)
    for f, cuts in enumerate(edges):
        codes[:, f] = np.searchsorted(cuts, x[:, f], side="left")
    return codes


