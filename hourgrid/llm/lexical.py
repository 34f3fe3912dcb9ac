"""Ranked lexical search by NRA: impact-sorted lists are read from the top, and score intervals decide when to stop.

Scores add, for each term of an item, a weight times a saturating share of the term's frequency, in whole numbers.

1. Items go in blocks of about ``BLOCK_BYTES`` of text; each block reads the documents once and writes what it needs of
   them: lengths, and the occurrences of its terms, in chunks of about 2 MB of text. Document counts and frequencies are
   sums over all chunks.
2. A task takes chunks until they have ``GROUP_POSTINGS`` occurrences, turns them into impacts and sorts each
   term's list by falling impact.
3. For an item, the lists of its terms are read in order, each round twice as deep as all before. What is read of a
   document is its lower bound; the next impact of every list that it has not been met in is added for the upper bound,
   and all next impacts together bound documents that were not met at all. Reading goes on until nothing unmet reaches
   the k-th best lower bound and no document that reaches it has an open interval: then membership, ties and scores are
   final. A list is read further only while a document with an open interval has not been met in it. Bounds of groups
   before tighten those after, in the same task.
4. Each task returns its best rows for each item, of which the k best over all tasks remain.

A null text, or one without terms, is no document and finds nothing as an item. Scores of 0 are left out. Equal scores
go by id, null last (and an id of 2^63 - 1 like null). Rows that repeat an id are documents of their own; a repeated
item row gets its results once for each row. Terms are compared by 64-bit hashes of their whole length; texts are read
whole, and a text longer than a chunk is a chunk. An empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from hourgrid.llm.words import PUNCTUATION, find_words, slices, texts_of
from hourgrid.session import materialize

K = 20
#: Item text for each pass over the documents; its terms and their numbers in the items take about 20 MB in a task.
BLOCK_BYTES = 4 << 20
#: Occurrences, and documents, that a task searches at a time.
GROUP_POSTINGS = 2_000_000
GROUP_DOCS = 1 << 16
#: Depth of the first round.
DEPTH = 128
#: Constants of the score.
SCALE = 1000
SATURATION = 12
SHARE = 25
_LAST = np.iinfo(np.int64).max
CHUNK = "doc_ids array<bigint>, lengths array<bigint>, terms array<int>, counts array<bigint>, docs array<int>, tfs array<bigint>"


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts, and where those of each text begin."""
    words = find_words(texts, PUNCTUATION, lower=True)
    return words.hashes(), words.first


def _chunks(vocabulary: np.ndarray):
    """Lengths of documents, and occurrences of the vocabulary by term, then document."""

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, first = terms_of(texts_of(batch))
            lengths = np.diff(first)
            filled = np.flatnonzero(lengths)
            owner = np.repeat(np.arange(len(filled)), lengths[filled])
            place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            known = vocabulary[place] == hashes
            keys, tfs = np.unique(place[known] * max(len(filled), 1) + owner[known], return_counts=True)
            term, doc = np.divmod(keys, max(len(filled), 1))
            terms, counts = np.unique(term, return_counts=True)
            columns = [batch.column("doc_id").take(pa.array(filled)), lengths[filled], terms.astype(np.int32), counts, doc.astype(np.int32), tfs]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(lists, names=["doc_ids", "lengths", "terms", "counts", "docs", "tfs"])

    return chunks


@dataclass
class Lists:
    """Impacts of a group of documents; those of term ``t`` are ``first[t]`` to ``first[t + 1] - 1``, falling."""

    ids: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, chunks: list[dict[str, np.ndarray]], weights: np.ndarray, documents: int, total: int) -> Lists:
        ids = np.concatenate([c["doc_ids"] for c in chunks])
        lengths = np.concatenate([c["lengths"] for c in chunks])
        offset = np.cumsum([0] + [len(c["doc_ids"]) for c in chunks])
        docs = np.concatenate([c["docs"].astype(np.int64) + o for c, o in zip(chunks, offset, strict=False)])
        term = np.concatenate([np.repeat(c["terms"], c["counts"]) for c in chunks])
        tfs = np.concatenate([c["tfs"] for c in chunks])
        m = 100 - SHARE + (SHARE * lengths * documents) // max(total, 1)
        impacts = weights[term] * ((SCALE**3 * tfs) // (SCALE * tfs + SATURATION * m[docs]))
        order = np.lexsort((docs, -impacts, term))
        first = np.searchsorted(term[order], np.arange(len(weights) + 1))
        return cls(ids, docs[order], impacts[order], first)


class Best:
    """The k best scores above 0 so far: from the highest, then from the smallest id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """A score below this one changes nothing any more."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search(lists: Lists, terms: np.ndarray, times: np.ndarray, best: Best) -> int:
    """Adds to ``best`` what the group's documents score for an item; returns how many list entries were read."""
    begin, stop = lists.first[terms], lists.first[terms + 1]
    some = stop > begin
    begin, stop, times = begin[some], stop[some], times[some]
    if not len(begin):
        return 0
    lower = np.zeros(len(lists.ids), np.int64)
    met = np.zeros(len(lists.ids), bool)
    read_docs, read_list = np.zeros(0, np.int64), np.zeros(0, np.int64)
    reached, wanted, step = begin.copy(), np.ones(len(begin), bool), DEPTH
    while True:
        until = np.where(wanted, np.minimum(stop, reached + step), reached)
        count = until - reached
        of_list = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(of_list)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(reached, count)
        docs = lists.docs[at]
        np.add.at(lower, docs, lists.impacts[at] * times[of_list])
        met[docs] = True
        read_docs, read_list = np.concatenate([read_docs, docs]), np.concatenate([read_list, of_list])
        reached, step = until, step * 2
        # what the next entry of each list can add
        following = np.where(reached < stop, lists.impacts[np.minimum(reached, stop - 1)], 0) * times
        unmet = int(following.sum())
        touched = np.flatnonzero(met)
        known = lower[touched]
        least = best.least()
        if len(touched) >= best.k:
            least = max(least, int(np.partition(known, len(known) - best.k)[len(known) - best.k]))
        if unmet >= least:
            continue
        counted = np.zeros(len(lists.ids), np.int64)
        np.add.at(counted, read_docs, following[read_list])
        rest = unmet - counted[touched]
        open_ = touched[(known + rest >= least) & (rest > 0)]
        if not len(open_):
            final = touched[(known >= least) & (rest == 0)]
            best.add(lower[final], lists.ids[final])
            return len(read_docs)
        mark = np.zeros(len(lists.ids), bool)
        mark[open_] = True
        # a list that all open documents were met in need not be read on
        wanted = (np.bincount(read_list[mark[read_docs]], minlength=len(begin)) < len(open_)) & (reached < stop)


def _search_all(items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, total: int, k: int):
    def search_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        waiting: list[dict[str, np.ndarray]] = []

        def settle():
            lists = Lists.of(waiting, weights, documents, total)
            for (terms, times), found in zip(items, best, strict=True):
                search(lists, terms, times, found)
            waiting.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                chunk = {c: batch.column(c)[row].values for c in batch.schema.names}
                chunk["doc_ids"] = chunk["doc_ids"].fill_null(int(_LAST))
                waiting.append({c: v.to_numpy(zero_copy_only=False).copy() for c, v in chunk.items()})
                if sum(len(c["docs"]) for c in waiting) >= GROUP_POSTINGS or sum(len(c["doc_ids"]) for c in waiting) >= GROUP_DOCS:
                    settle()
        if waiting:
            settle()
        which = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        ids, scores = (np.concatenate([np.zeros(0, np.int64), *(getattr(b, c) for b in best)]) for c in ("ids", "scores"))
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return search_all


def _block_of_items(docs: DataFrame, block: list[Row], kind: str, k: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` for a block of items (``item_id, text, times``)."""
    spark = docs.sparkSession
    hashes, first = terms_of([r["text"].encode("utf-8", "surrogatepass") for r in block])
    vocabulary = np.unique(hashes)
    said = f"item_id {kind}, rank int, doc_id long, score long"
    if not len(vocabulary):
        return spark.createDataFrame([], said)
    own = [np.unique(np.searchsorted(vocabulary, hashes[a:b]), return_counts=True) for a, b in zip(first, first[1:], strict=False)]
    chunks = materialize(docs.mapInArrow(_chunks(vocabulary), CHUNK), "chunks")
    summed = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    documents, total = chunks.agg(F.sum(F.size("lengths").cast("long")), F.sum(summed("lengths"))).collect()[0]
    if not documents:
        return spark.createDataFrame([], said)
    frequency = chunks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df"))
    weight = F.floor(SCALE * F.log(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1)))
    weights = np.zeros(len(vocabulary), np.int64)
    for row in frequency.select("terms", weight.alias("weight")).collect():
        weights[row["terms"]] = row["weight"]
    found = chunks.mapInArrow(_search_all(own, weights, documents, total, k), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    found = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"], r["times"]) for i, r in enumerate(block)], f"item int, item_id {kind}, times long")
    rows = found.join(names, "item").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return rows.select("item_id", "rank", F.nullif(F.col("doc_id"), F.lit(int(_LAST))).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score above 0 for each row of ``items``."""
    kind = dict(items.dtypes)[item_id]
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text")).where(F.col("text").isNotNull())
    asked = items.select(items[f"`{item_id}`"].alias("item_id"), items[f"`{item_text}`"].alias("text")).where(F.col("text").isNotNull())
    asked = asked.groupBy("item_id", "text").agg(F.count("*").alias("times"))
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0) // block_bytes)
    results = []
    for block in range(blocks):
        chosen = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        if chosen:
            # with several blocks, only one is on the driver at a time
            found = _block_of_items(rows, chosen, kind, k)
            results.append(found if blocks == 1 else materialize(found, "ranked"))
    if not results:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    result = results[0]
    for more in results[1:]:
        result = result.unionByName(more)
    return result
