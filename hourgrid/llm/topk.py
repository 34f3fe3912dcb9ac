"""Exact top-k search by inner product, a block at a time.

Rows lie in blocks, ranges of consecutive rows of a batch sorted by vector, so that a block holds similar vectors. For
each block and dimension its index keeps the largest and the smallest value; the sum over the dimensions of what a
query could gain at most is the block's bound. A query visits the blocks from the highest bound down, scores a block's
forward index (its vectors) as a whole, and stops when the next bound lies below its k-th best score. All queries that
visit a block in the same round are scored together.

Queries go to the tasks in parts of ``QUERY_BLOCK`` distinct vectors; each part scans the table once, and the results of
a part are written before the next part's vectors are fetched. Every task
returns its k + 1 best rows per query, of which the k best over all tasks remain, so nothing grows with the table.

Vectors that are null, empty or hold null or non-finite components take no part, neither as queries nor as
candidates; a query is compared only with vectors of its own length. Of rows that repeat a query's id and vector, one
is the query itself and the others are candidates; a repeated query row gets its results once for each row. Rows with
a null id are candidates with the largest id on a tie, and never queries. Scores must fit into a long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.session import materialize

K = 5
SCALE = 256
#: Distinct queries per pass over the table; at 64 dimensions 8 MB.
QUERY_BLOCK = 16_384
BLOCK = 128
_EXACT = 1 << 53
_LAST = np.iinfo(np.int64).max


def whole_components(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product of whole matrices: by floating point where every sum fits its mantissa."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= _LAST:
        raise OverflowError("a score may not fit into a long")
    return a @ b.T


class BestRows:
    """The best rows found so far, for each of some queries: score from the highest, then id from the smallest."""

    def __init__(self, queries: int, size: int):
        self.ids = np.full((queries, size), _LAST)
        self.scores = np.full((queries, size), np.iinfo(np.int64).min)
        self.filled = np.zeros((queries, size), bool)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows ``ids`` with ``scores[i, j]`` for query ``at[i]`` and row ``j``."""
        size = self.ids.shape[1]
        all_ids = np.concatenate([self.ids[at], np.broadcast_to(ids, scores.shape)], axis=1)
        all_scores = np.concatenate([self.scores[at], scores], axis=1)
        filled = np.concatenate([self.filled[at], np.ones(scores.shape, bool)], axis=1)
        order = np.lexsort((all_ids, -all_scores, ~filled), axis=1)[:, :size]
        for name, values in (("ids", all_ids), ("scores", all_scores), ("filled", filled)):
            getattr(self, name)[at] = np.take_along_axis(values, order, axis=1)


def search_blocks(best: BestRows, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> int:
    """Adds what ``vectors`` offer to ``best``; returns how many query-block pairs were scored."""
    order = np.lexsort(vectors.T[::-1])
    ids, vectors = ids[order], vectors[order]
    cuts = np.arange(0, len(ids), BLOCK)
    top, bottom = np.maximum.reduceat(vectors, cuts), np.minimum.reduceat(vectors, cuts)
    bounds = _product(np.maximum(queries, 0), top) + _product(np.minimum(queries, 0), bottom)
    ranking = np.argsort(-bounds, axis=1, kind="stable")
    active, scored = np.arange(len(queries)), 0
    for turn in range(len(cuts)):
        block = ranking[active, turn]
        open_ = ~best.filled[active, -1] | (bounds[active, block] >= best.scores[active, -1])
        active, block = active[open_], block[open_]
        if not len(active):
            break
        scored += len(active)
        by_block = np.argsort(block, kind="stable")
        for group in np.split(by_block, np.flatnonzero(np.diff(block[by_block])) + 1):
            at, b = active[group], block[group[0]]
            rows = slice(cuts[b], cuts[b] + BLOCK)
            best.add(at, ids[rows], _product(queries[at], vectors[rows]))
    return scored


def _task(queries: np.ndarray, k: int):
    def best_of_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestRows(len(queries), k + 1)
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
                search_blocks(best, queries, ids, batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1))
        at, place = np.nonzero(best.filled)
        arrays = [pa.array(at, pa.int32()), pa.array(best.ids[at, place]), pa.array(best.scores[at, place])]
        yield pa.RecordBatch.from_arrays(arrays, names=["query", "vec_id", "score"])

    return best_of_task


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "vector", query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of highest inner product for each row of ``queries``.

    Both tables hold arrays of longs. A query's own row in ``vectors`` is not among its results.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    asked = queries.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.col("vec_id").isNotNull())
    asked = asked.groupBy("vec_id", "vector").agg(F.count("*").alias("times")).withColumn("size", F.size("vector"))
    parts = []
    for size, n in sorted((r["size"], r["count"]) for r in asked.groupBy("size").count().collect()):
        blocks = -(-n // query_block)
        for block in range(blocks):
            chosen = asked.where((F.col("size") == size) & (F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)) == block))
            part = chosen.select("vec_id", "vector", "times").orderBy("vec_id", "vector").collect()
            if not part:
                continue
            matrix = np.array([r["vector"] for r in part], np.int64)
            own = (_product_rows(matrix)).tolist()
            names = [(i, r["vec_id"], own[i], r["times"]) for i, r in enumerate(part)]
            named = spark.createDataFrame(names, "query int, query_id long, own_score long, times long")
            candidates = rows.where(F.size("vector") == size).select(F.coalesce("vec_id", F.lit(int(_LAST) - 1)).alias("vec_id"), "vector")
            found = candidates.mapInArrow(_task(matrix, k), "query int, vec_id long, score long")
            order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
            found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).join(named, "query")
            # of the rows that equal the query in id and score, the first is its own
            own_row = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own_score"))
            own_place = F.min(F.when(own_row, F.col("place"))).over(Window.partitionBy("query"))
            found = found.withColumn("own", own_place).where(F.col("own").isNull() | (F.col("place") != F.col("own")))
            rank = (F.col("place") - F.when(F.col("place") > F.col("own"), 1).otherwise(0)).cast("int")
            found = found.withColumn("rank", rank).where(F.col("rank") <= k)
            found = found.select("query_id", "rank", F.when(F.col("vec_id") < int(_LAST) - 1, F.col("vec_id")).alias("vec_id"), "score", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col")
            # with several blocks, only one is on the driver at a time
            parts.append(found if blocks == 1 else materialize(found, "found"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _product_rows(matrix: np.ndarray) -> np.ndarray:
    most = float(np.abs(matrix).max(initial=0)) ** 2 * matrix.shape[1]
    if most >= _LAST:
        raise OverflowError("a score may not fit into a long")
    return (matrix * matrix).sum(axis=1)
