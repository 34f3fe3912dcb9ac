"""Gradient-boosted trees with Poisson loss, grown from histograms of binned features.

With the log link ``mu = exp(eta)``, the gradient of the loss is ``mu - y`` and its curvature ``mu``. A tree takes one
Newton step: a split's gain is what it adds to ``sum(y - mu) ** 2 / (sum(mu) + l2)`` over its sides, and a leaf's value
``learning_rate * sum(y - mu) / (sum(mu) + l2)``.

Several models that learn from rows of one table, such as the folds and configurations of a backtest, are fitted
together. The table is binned once, into one byte per feature and training set. Each level of all models' next trees is
one pass over that table: tasks sum gradients, curvatures and rows by node, feature and bin, the sums are added by node
and feature, and the best splits of each node reach the driver. The trees since the table was last written travel with the
pass; every ``cut_lineage_every`` trees the table is written with the new ``eta``, so that neither a pass nor a recovery
grows with the number of trees.

Trees grow level by level; ``max_depth`` 5 gives at most 32 leaves. Equal gains favour the first feature and the lowest bin.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from hourgrid.models.trees import MAX_BINS, Tree, bin_edges, codes_of, matrix
from hourgrid.session import materialize

#: Both sides of a split have at least this curvature.
LEAST_CURVATURE = 1e-3
#: Gains are compared to so many decimals, so that the order in which partial sums arrive decides nothing.
GAIN_DECIMALS = 6
HISTOGRAM = "fit int, node int, feature int, bins array<int>, g array<double>, h array<double>, n array<bigint>"
SPLIT = "fit int, node int, feature int, gain double, bin int, g_left double, h_left double, n_left bigint, g double, h double, n bigint"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Step:
    """One tree and the value each of its leaves adds to ``eta``; leaves are numbered from 0."""

    tree: Tree
    values: tuple[float, ...]


@dataclass(frozen=True)
class Settings:
    trees: int = 200
    learning_rate: float = 0.08
    max_depth: int = 5
    l2: float = 1.0
    max_bins: int = MAX_BINS
    min_rows_per_leaf: int = 20
    cut_lineage_every: int = 10


class PoissonTreesModel(Model):
    def __init__(self, base: float, steps: list[Step], features: str, prediction: str):
        super().__init__()
        self.base = base
        self.steps = steps
        self.features = features
        self.prediction = prediction

    def eta(self, vector: Column) -> Column:
        """The sum of all steps; the plan does not grow with the number of trees."""
        base, steps = self.base, [(s.tree, np.array(s.values)) for s in self.steps]

        @F.pandas_udf("double")
        def total(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in values:
                x, eta = matrix(part), np.full(len(part), base)
                for tree, of_leaf in steps:
                    eta += of_leaf[tree.leaf_of(x)]
                yield pd.Series(eta)

        return total(vector_to_array(vector))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.prediction, F.exp(self.eta(F.col(self.features))))

    def first(self, trees: int) -> PoissonTreesModel:
        """The model after its first ``trees`` steps."""
        return PoissonTreesModel(self.base, self.steps[:trees], self.features, self.prediction)


@dataclass
class _Growing:
    """A tree on codes whose leaves in ``frontier`` may still be split; ``sums`` are each leaf's g, h and n."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    parent: list[tuple[int, int] | None] = field(default_factory=lambda: [None])
    sums: list[tuple[float, float, int]] = field(default_factory=lambda: [(0.0, 0.0, 0)])
    frontier: list[int] = field(default_factory=lambda: [0])

    def on_codes(self) -> Tree:
        return Tree(tuple(self.feature), tuple(self.bin), *(tuple(c[side] for c in self.children) for side in (0, 1)))

    def grow(self, best: dict[int, dict], min_rows: int) -> None:
        """Split the leaves of the frontier by the best split of each, given by its place there."""
        reached = []
        for place, leaf in enumerate(self.frontier):
            split = best.get(place)
            if split is None:
                continue
            whole = split["g"], split["h"], split["n"]
            self.sums[leaf] = whole
            if not split["gain"] > 0:
                continue
            node, new = len(self.feature), len(self.sums)
            self.feature.append(split["feature"])
            self.bin.append(split["bin"])
            self.children.append([~leaf, ~new])
            if self.parent[leaf] is not None:
                above, side = self.parent[leaf]
                self.children[above][side] = node
            left = split["g_left"], split["h_left"], split["n_left"]
            self.sums[leaf] = left
            self.sums.append(tuple(a - b for a, b in zip(whole, left, strict=True)))
            self.parent[leaf] = (node, 0)
            self.parent.append((node, 1))
            reached += [leaf, new]
        self.frontier = [leaf for leaf in reached if self.sums[leaf][2] >= 2 * min_rows]


@dataclass(frozen=True)
class Fit:
    """One of the models that are fitted together: its training set, by number, and the features it may use."""

    member: int
    features: tuple[int, ...]


@dataclass(frozen=True)
class _Work:
    """What a task has to know of one fit: steps on codes since the table was written, and the tree that grows."""

    member: int
    features: np.ndarray
    steps: list[Step]
    tree: Tree
    frontier: np.ndarray


def _codes(batch: pa.RecordBatch, member: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the rows that belong to a training set, and which rows these are."""
    column = batch.column(f"codes_{member}")
    codes = np.frombuffer(b"".join(column.drop_null().to_pylist()), np.uint8).reshape(-1, width)
    return codes, np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))


def _etas(batch: pa.RecordBatch, fits: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("eta").to_pylist()), np.float64).reshape(-1, fits)


def _after(eta: np.ndarray, steps: list[Step], codes: np.ndarray) -> np.ndarray:
    for step in steps:
        eta = eta + np.array(step.values)[step.tree.leaf_of(codes)]
    return eta


def _histograms(works: list[_Work], widths: list[np.ndarray]):
    """Sums by fit, node, feature and bin of a task's rows; ``widths`` are the bins of each feature, by training set."""

    def histograms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [np.concatenate([[0], np.cumsum(w)]) for w in widths]
        sums = [np.zeros((3, len(w.frontier) * first[w.member][-1])) for w in works]
        for batch in batches:
            y, etas = batch.column("y").to_numpy(), _etas(batch, len(works))
            of_member = {}
            for i, work in enumerate(works):
                if not len(work.frontier):
                    continue
                if work.member not in of_member:
                    of_member[work.member] = _codes(batch, work.member, len(widths[work.member]))
                codes, rows = of_member[work.member]
                place = np.full(len(work.tree.feature) + 1, -1)
                place[work.frontier] = np.arange(len(work.frontier))
                node = place[work.tree.leaf_of(codes)]
                here = np.flatnonzero(node >= 0)
                mu = np.exp(_after(etas[rows[here], i], work.steps, codes[here]))
                offsets = first[work.member]
                keys = (node[here, None] * offsets[-1] + offsets[work.features] + codes[here][:, work.features]).ravel()
                for s, weight in enumerate((y[rows[here]] - mu, mu, None)):
                    weight = None if weight is None else np.repeat(weight, len(work.features))
                    sums[i][s] += np.bincount(keys, weight, sums[i].shape[1])
        for i, work in enumerate(works):
            offsets = first[work.member]
            filled = np.flatnonzero(sums[i][2])
            node, slot = np.divmod(filled, offsets[-1])
            feature = np.searchsorted(offsets, slot, "right") - 1
            group = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (feature[1:] != feature[:-1]))) if len(filled) else filled
            ends = pa.array(np.append(group, len(filled)), pa.int32())
            lists = [slot - offsets[feature], sums[i][0][filled], sums[i][1][filled], sums[i][2][filled]]
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(t))) for v, t in zip(lists, (np.int32, float, float, np.int64), strict=True)]
            names = [pa.array(np.full(len(group), i, np.int32)), pa.array(node[group].astype(np.int32)), pa.array(feature[group].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*names, *lists], names=["fit", "node", "feature", "bins", "g", "h", "n"])

    return histograms


def _best_splits(l2: float, min_rows: int):
    """The best split of every fit and node among the features of which a task has all partial sums."""

    def best_splits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple[int, int, int], int] = {}
        sums = np.zeros((3, 0, MAX_BINS))
        for batch in batches:
            names = zip(*(batch.column(c).to_pylist() for c in ("fit", "node", "feature")), strict=True)
            at = np.array([place.setdefault(name, len(place)) for name in names], int)
            if len(place) > sums.shape[1]:
                sums = np.concatenate([sums, np.zeros((3, max(len(place) - sums.shape[1], sums.shape[1]), MAX_BINS))], axis=1)
            cells = np.repeat(at, pc.list_value_length(batch.column("bins")).to_numpy()) * MAX_BINS + batch.column("bins").flatten().to_numpy()
            for s, c in enumerate(("g", "h", "n")):
                np.add.at(sums[s].reshape(-1), cells, batch.column(c).flatten().to_numpy())
        g, h, n = np.cumsum(sums[:, : len(place)], axis=2)
        whole_g, whole_h, whole_n = g[:, -1:], h[:, -1:], n[:, -1:]
        gain = g**2 / (h + l2) + (whole_g - g) ** 2 / (whole_h - h + l2) - whole_g**2 / (whole_h + l2)
        fair = (np.minimum(n, whole_n - n) >= max(min_rows, 1)) & (np.minimum(h, whole_h - h) >= LEAST_CURVATURE)
        gain = np.where(fair, np.round(gain, GAIN_DECIMALS), -np.inf)
        bins = gain.argmax(axis=1) if len(place) else np.zeros(0, int)
        keys = np.array(list(place), np.int32).reshape(-1, 3)
        rows = np.lexsort((keys[:, 2], -gain.max(axis=1, initial=-np.inf), keys[:, 1], keys[:, 0]))
        rows = rows[np.append(True, (np.diff(keys[rows, :2], axis=0) != 0).any(axis=1))[: len(rows)]]
        bins, whole_g, whole_h, whole_n = bins[rows], whole_g[rows], whole_h[rows], whole_n[rows]
        columns = [*keys[rows].T, gain[rows, bins], bins.astype(np.int32), *(x[rows, bins] for x in (g, h, n)), whole_g[:, 0], whole_h[:, 0], whole_n[:, 0]]
        columns[7], columns[10] = columns[7].astype(np.int64), columns[10].astype(np.int64)
        names = ["fit", "node", "feature", "gain", "bin", "g_left", "h_left", "n_left", "g", "h", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    return best_splits


def _with_codes(edges: list[list[np.ndarray]], bases: list[float]):
    eta = np.array(bases).tobytes()

    def with_codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("values").flatten().to_numpy().reshape(batch.num_rows, -1)
            columns = [batch.column("y"), pa.array([eta] * batch.num_rows, pa.binary())]
            for m, cuts in enumerate(edges):
                inside = batch.column(f"in_{m}").to_pylist()
                codes = codes_of(x, cuts)
                columns.append(pa.array([row.tobytes() if own else None for own, row in zip(inside, codes, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["y", "eta", *(f"codes_{m}" for m in range(len(edges)))])

    return with_codes


def _with_steps(works: list[_Work], widths: list[np.ndarray]):
    def with_steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            etas = _etas(batch, len(works)).copy()
            for i, work in enumerate(works):
                codes, rows = _codes(batch, work.member, len(widths[work.member]))
                etas[rows, i] = _after(etas[rows, i], work.steps, codes)
            columns = {name: batch.column(name) for name in batch.schema.names} | {"eta": pa.array([e.tobytes() for e in etas], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    return with_steps


def _cached(df: DataFrame, name: str) -> DataFrame:
    return materialize(df, name).persist(StorageLevel.MEMORY_AND_DISK)


def fit_together(dataset: DataFrame, vector: str, label: str, members: Sequence[Column], fits: Sequence[Fit], settings: Settings) -> list[tuple[float, list[Step]]]:
    """Base and steps of every fit. ``members`` are the conditions of the training sets on rows of ``dataset``."""
    names = [f"in_{m}" for m in range(len(members))]
    inside = [F.coalesce(condition, F.lit(False)).alias(name) for condition, name in zip(members, names, strict=True)]
    rows = dataset.select(vector_to_array(vector).alias("values"), F.col(label).cast("double").alias("y"), *inside)
    rows = materialize(rows.where(" OR ".join(names)), "training")
    means = rows.agg(*[F.avg(F.when(F.col(n), F.col("y"))) for n in names]).first()
    if any(not mean or mean < 0 for mean in means):
        raise ValueError("a Poisson model needs labels with a positive mean")
    bases = [math.log(means[f.member]) for f in fits]
    steps: list[list[Step]] = [[] for _ in fits]
    if not settings.trees:
        return list(zip(bases, steps, strict=True))

    edges = bin_edges(rows, "values", names, settings.max_bins)
    widths = [np.array([len(cuts) + 1 for cuts in of_member]) for of_member in edges]
    schema = "y double, eta binary, " + ", ".join(f"codes_{m} binary" for m in range(len(members)))
    state = _cached(rows.mapInArrow(_with_codes(edges, bases), schema), "codes")
    recent: list[list[Step]] = [[] for _ in fits]

    def work(growing: Sequence[_Growing] | None = None) -> list[_Work]:
        trees = [g.on_codes() for g in growing] if growing else [Tree((), (), (), ())] * len(fits)
        frontiers = [np.array(g.frontier, int) for g in growing] if growing else [np.zeros(0, int)] * len(fits)
        return [_Work(f.member, np.array(f.features, int), *of) for f, *of in zip(fits, recent, trees, frontiers, strict=True)]

    try:
        for number in range(1, settings.trees + 1):
            growing = [_Growing() for _ in fits]
            for _ in range(settings.max_depth):
                if not any(g.frontier for g in growing):
                    break
                sums = state.mapInArrow(_histograms(work(growing), widths), HISTOGRAM).repartition("fit", "node", "feature")
                best: list[dict[int, dict]] = [{} for _ in fits]
                for row in sums.mapInArrow(_best_splits(settings.l2, settings.min_rows_per_leaf), SPLIT).collect():
                    other = best[row["fit"]].get(row["node"])
                    if other is None or (row["gain"], -row["feature"]) > (other["gain"], -other["feature"]):
                        best[row["fit"]][row["node"]] = row.asDict()
                for g, found in zip(growing, best, strict=True):
                    g.grow(found, settings.min_rows_per_leaf)
            for i, g in enumerate(growing):
                values = tuple(settings.learning_rate * a / (b + settings.l2) for a, b, _ in g.sums)
                on_codes = g.on_codes()
                recent[i].append(Step(on_codes, values))
                cuts = edges[fits[i].member]
                thresholds = tuple(float(cuts[f][b]) for f, b in zip(on_codes.feature, on_codes.threshold, strict=True))
                steps[i].append(Step(Tree(on_codes.feature, thresholds, on_codes.left, on_codes.right), values))
            if number % settings.cut_lineage_every == 0 and number < settings.trees:
                before, state = state, _cached(state.mapInArrow(_with_steps(work(), widths), schema), "codes")
                before.unpersist()
                recent = [[] for _ in fits]
    finally:
        # a failed fit leaves no cached rows either
        state.unpersist()
    return list(zip(bases, steps, strict=True))


class PoissonTrees(Estimator):
    """Fits ``trees`` Newton steps on a vector column of features and a non-negative label."""

    def __init__(self, features: str = "features", label: str = "pickups", prediction: str = "prediction", **settings):
        super().__init__()
        self.features = features
        self.label = label
        self.prediction = prediction
        self.settings = Settings(**settings)

    def _fit(self, dataset: DataFrame) -> PoissonTreesModel:
        first = dataset.select(F.size(vector_to_array(self.features))).first()
        every = Fit(0, tuple(range(first[0] if first else 0)))
        base, steps = fit_together(dataset, self.features, self.label, [F.lit(True)], [every], self.settings)[0]
        return PoissonTreesModel(base, steps, self.features, self.prediction)


def poisson_deviance(label: Column, prediction: Column) -> Column:
    """Mean deviance of positive predictions, as an aggregate; a zero label contributes its limit."""
    y = label.cast("double")
    log_term = F.when(y > 0, y * F.ln(y / prediction)).otherwise(0.0)
    return F.avg(2 * (log_term - y + prediction))
