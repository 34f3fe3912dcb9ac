"""Substring dedup: seeds from winnowing, extended to maximal repeats of at least ``window`` words.

1. Seeds. In every window of ``window`` words the ``gram``-word sequence of least hash (the last one on a tie) is the
   window's anchor. Windows with equal words have equal anchors, so anchors that occur once cannot be in a repeat.
   Consecutive windows with one anchor form a run; only the runs travel, about two for every ``window - gram`` words.
2. Extension. Equal anchors meet. If all runs around an anchor have the same words, the match extends over the whole
   run, for every occurrence. Otherwise the runs differ somewhere, and their windows are matched one by one, which
   finds how far each match extends to the left and to the right.
3. Overlapping matched windows of one document add up to its maximal repeats.

All groups are counted with partial sums, and nothing is paired within a group, so a passage in a third of all
documents costs a row per occurrence. Matches compare an anchor hash and a run or window hash, 128 bits in all.

Empty and null texts have no words and nothing to remove; a text shorter than the window is kept whole; repeated rows
are repeats of each other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.staging import identified
from hourgrid.llm.words import find_words, run_hashes, slices, texts_of
from hourgrid.session import materialize

WINDOW = 35
GRAM = 8
KEY = ["row_id", "row_hash"]


def anchored_runs(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each run: its text, its anchor's hash, its hash, its first window within the text, its number of windows."""
    count = np.maximum(np.diff(first) - window + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    starts = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    at = np.arange(len(hashes) - gram + 1)
    grams = run_hashes(hashes, at, at + gram)
    span, reach, best = window - gram + 1, 1, at

    def later(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[b] <= grams[a], b, a)

    while 2 * reach <= span:
        best = later(best[:-reach], best[reach:])
        reach *= 2
    best = later(best[: len(at) - span + 1], best[span - reach : span - reach + len(at) - span + 1])
    anchor = best[starts]
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])) + 1
    head = np.concatenate([[0], change])
    size = np.diff(np.concatenate([head, [len(starts)]]))
    begin = starts[head]
    return owner[head], grams[anchor[head]], run_hashes(hashes, begin, begin + size + window - 1), begin - first[owner[head]], size


def _emit_runs(window: int, gram: int):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = find_words(texts_of(batch))
            owner, anchor, run, start, size = anchored_runs(words.hashes(), words.first, window, gram)
            ids = [batch.column(c).to_numpy(zero_copy_only=False)[owner] for c in KEY]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.int64()), pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), pa.array(start, pa.int32()), pa.array(size, pa.int32())],
                names=[*KEY, "anchor", "run", "start", "size"],
            )

    return emit


def _emit_windows(window: int):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = find_words(texts_of(batch))
            hashes, runs = words.hashes(), batch.column("runs")
            owner = np.repeat(np.arange(batch.num_rows), runs.value_lengths().to_numpy())
            start, size, anchor = (runs.flatten().field(k).to_numpy() for k in range(3))
            place = np.repeat(np.arange(len(owner)), size)
            at = start[place] + np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
            begin = words.first[owner[place]] + at
            ids = [batch.column(c).to_numpy(zero_copy_only=False)[owner[place]] for c in KEY]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.int64()), pa.array(anchor[place]), pa.array(run_hashes(hashes, begin, begin + window).view(np.int64)), pa.array(at, pa.int32())],
                names=[*KEY, "anchor", "words", "start"],
            )

    return emit


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``row_id, row_hash, start, size``: stretches of words, counted from 0, in which every window of the text is a repeat.

    ``docs`` comes from ``identified``. Spans of one text may touch or overlap; a repeated row gives its spans again.
    """
    key_types = "row_id long, row_hash long, anchor long"
    runs = docs.mapInArrow(_emit_runs(window, gram), f"{key_types}, run long, start int, size int")
    seeds = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("run").alias("least"), F.max("run").alias("most"))
    seeds = materialize(seeds.where("n > 1").select("anchor", (F.col("least") == F.col("most")).alias("alike")), "seeds")
    met = materialize(runs.join(seeds, "anchor").select(*KEY, "anchor", "start", "size", "alike"), "runs")

    unlike = met.where("NOT alike").groupBy(*KEY).agg(F.collect_set(F.struct("start", "size", "anchor")).alias("runs"))
    windows = docs.select(*KEY, "text").join(unlike, KEY).mapInArrow(_emit_windows(window), f"{key_types}, words long, start int")
    windows = materialize(windows, "windows")
    matched = materialize(windows.groupBy("anchor", "words").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "words"), "matches")
    whole = met.where("alike").select(*KEY, "start", (F.col("size") + F.lit(window - 1)).alias("size"))
    return whole.unionByName(windows.join(matched, ["anchor", "words"]).select(*KEY, "start", F.lit(window).alias("size")))


def _keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = find_words(texts_of(batch))
        spans = batch.column("spans")
        lengths = np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        owner = np.repeat(np.arange(batch.num_rows), lengths)
        start, size = (spans.flatten().field(k).to_numpy() for k in range(2))
        edges = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(edges, words.first[owner] + start, 1)
        np.add.at(edges, words.first[owner] + start + size, -1)
        gone = np.cumsum(edges)[:-1] > 0
        kept_texts, digests = [], []
        for i in range(batch.num_rows):
            kept = b" ".join(words.text(w) for w in np.flatnonzero(~gone[words.first[i] : words.first[i + 1]]) + words.first[i])
            kept_texts.append(kept)
            digests.append(hashlib.sha256(kept).hexdigest())
        total = np.concatenate([[0], np.cumsum(gone)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), pa.array(np.diff(total[words.first]), pa.int64()), pa.array(kept_texts, pa.binary()).cast(pa.string()), pa.array(digests)],
            names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_text, kept_sha256``.

    A word goes if a window of ``window`` words over it also starts anywhere else. Kept words are joined by one space.
    """
    if gram >= window:
        raise ValueError("an anchor must be shorter than the window")
    rows = identified(docs, doc_id, text)
    spans = repeated_spans(rows, window, gram).groupBy(*KEY).agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    joined = rows.join(spans, KEY, "left").select("doc_id", "text", "spans")
    kind = dict(joined.dtypes)["doc_id"]
    return joined.mapInArrow(_keep, f"doc_id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string")
