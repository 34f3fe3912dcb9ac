"""Benchmark decontamination: fingerprints of item-sized windows, a Hamming index, and an exact check.

1. A benchmark item of n words is compared with windows of n words of the documents, and a document of fewer words is
   one window as a whole. Windows without a shingle of the item have similarity 0 and are not fingerprinted.
2. The SimHash of a window adds the signs of its shingles, each as often as it occurs, in 128 bits; running sums give
   every window of a size in one pass.
3. Fingerprints within ``RADIUS`` of an item's differ by at most ``RADIUS // BLOCKS`` bits in one of ``BLOCKS`` blocks of
   16 bits. The index lists the items under all block values within two bits, and a window asks for all values within
   one, so no fingerprint within the radius is missed.
4. Items that the index names, and whose distance is within the radius, are checked: the weighted Jaccard similarity
   of both multisets of shingles, smallest count over largest count, must reach the threshold.

Words are runs of letters and digits, A-Z in lower case. Items go to the tasks in parts of ``ITEM_BLOCK``, each with a
pass over the documents; shingles of items are the only thing that travels, and texts are never shuffled.

Items and documents that are null or shorter than a shingle match nothing; repeated rows give their matches again; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.words import PUNCTUATION, find_words, mixed, run_hashes, slices, texts_of
from hourgrid.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
#: Windows with the least similarity lie within it with a chance of 99.8 %, more similar ones with a greater.
RADIUS = 31
BLOCKS = 8
#: Items per pass; an item takes about 9 KB in a task.
ITEM_BLOCK = 5_000


def _within(distance: int) -> np.ndarray:
    """The differences of 16-bit values that lie at most ``distance`` bits apart."""
    return np.array([sum(1 << b for b in bits) for r in range(distance + 1) for bits in combinations(range(16), r)], np.uint16)


_LISTED, _ASKED = _within(2), _within(1)
assert RADIUS // BLOCKS <= 3


def _signs(shingles: np.ndarray) -> np.ndarray:
    """The 128 signs of each shingle."""
    halves = np.stack([mixed(shingles ^ np.uint64(0xA0761D6478BD642F)), mixed(shingles ^ np.uint64(0xE7037ED1A0B428DB))], axis=1)
    return np.unpackbits(halves.view(np.uint8), axis=1).astype(np.int16) * 2 - 1


def _blocks(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as 8 blocks of 16 bits; a bit is set if its sum is positive."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    values, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(which[: len(a)], minlength=len(values)), np.bincount(which[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / max(np.maximum(x, y).sum(), 1))


def _shingles(hashes: np.ndarray) -> np.ndarray:
    at = np.arange(max(len(hashes) - SHINGLE + 1, 0))
    return run_hashes(hashes, at, at + SHINGLE)


class Items:
    """Items with the index of their shingles and of their fingerprints."""

    def __init__(self, ids: list, texts: list[str]):
        words = find_words([t.encode("utf-8", "surrogatepass") for t in texts], PUNCTUATION, lower=True)
        hashes = words.hashes()
        parts = [_shingles(hashes[words.first[i] : words.first[i + 1]]) for i in range(len(texts))]
        use = [i for i, p in enumerate(parts) if len(p)]
        self.ids = [ids[i] for i in use]
        self.shingles = [parts[i] for i in use]
        self.sizes = np.array([len(p) + SHINGLE - 1 for p in self.shingles], np.int64)
        if not use:
            return
        owners = np.repeat(np.arange(len(use)), [len(p) for p in self.shingles])
        keys = np.concatenate(self.shingles)
        # every shingle once for each size of its items, so that windows of that size are looked at
        pairs = pd.DataFrame({"key": keys, "size": self.sizes[owners]}).drop_duplicates().sort_values(["key", "size"])
        self.keys, first = np.unique(pairs["key"].to_numpy(), return_index=True)
        self.key_ends = np.append(first[1:], len(pairs))
        self.key_starts, self.key_sizes = first, pairs["size"].to_numpy()
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.keys & np.uint64((1 << 20) - 1)] = True
        self.prints = np.concatenate([_blocks(_signs(p).sum(axis=0, dtype=np.int64)[None, :]) for p in self.shingles])
        entries = (self.prints[:, :, None] ^ _LISTED).reshape(-1)
        block = np.tile(np.repeat(np.arange(BLOCKS, dtype=np.int32), len(_LISTED)), len(use))
        code = block << 16 | entries
        item = np.repeat(np.arange(len(use), dtype=np.int32), BLOCKS * len(_LISTED))
        order = np.argsort(code, kind="stable")
        self.codes, self.code_items = code[order], item[order]

    def nearby(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of print and item within the radius, found through the blocks."""
        code = (np.arange(BLOCKS, dtype=np.int32)[:, None] << 16 | (prints[:, :, None] ^ _ASKED)).ravel()
        low, high = np.searchsorted(self.codes, code, "left"), np.searchsorted(self.codes, code, "right")
        count = high - low
        at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pairs = np.unique(np.repeat(np.arange(len(prints)).repeat(BLOCKS * len(_ASKED)), count) * len(self.ids) + self.code_items[at])
        which, item = pairs // len(self.ids), pairs % len(self.ids)
        distance = np.bitwise_count(prints[which] ^ self.prints[item]).sum(axis=1)
        return which[distance <= RADIUS], item[distance <= RADIUS]

    def matches(self, shingles: np.ndarray, threshold: float) -> list[tuple[int, float, int]]:
        """``(item, similarity, first word)`` of the best window for each item that the text's shingles contain, or nearly are."""
        seen = np.flatnonzero(self.filter[shingles & np.uint64((1 << 20) - 1)])
        place = np.minimum(np.searchsorted(self.keys, shingles[seen]), len(self.keys) - 1)
        real = self.keys[place] == shingles[seen]
        seen, place = seen[real], place[real]
        if not len(seen):
            return []
        count = self.key_ends[place] - self.key_starts[place]
        at = np.repeat(self.key_starts[place], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        sizes, hits = self.key_sizes[at], np.repeat(seen, count)
        best: dict[int, tuple[float, int]] = {}
        own = len(shingles) + SHINGLE - 1
        if (sizes > own).any():
            # as a whole, the text is the only window for items that are longer
            _, item = self.nearby(_blocks(_signs(shingles).sum(axis=0, dtype=np.int64)[None, :]))
            for i in item[(self.sizes[item] > own) & (len(shingles) >= threshold * (self.sizes[item] - SHINGLE + 1) - 1e-9)].tolist():
                found = (weighted_similarity(shingles, self.shingles[i]), 0)
                if found[0] >= threshold:
                    best[i] = found
        for size in np.unique(sizes[sizes <= own]):
            span = size - SHINGLE + 1
            edges = np.zeros(len(shingles) + 2, np.int64)
            hit = hits[sizes == size]
            np.add.at(edges, np.maximum(hit - span + 1, 0), 1)
            np.add.at(edges, np.minimum(hit, len(shingles) - span) + 1, -1)
            starts = np.flatnonzero(np.cumsum(edges)[: len(shingles) - span + 1] > 0)
            for stretch in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for part in np.array_split(stretch, -(-len(stretch) // 4096)):
                    sums = np.zeros((len(part) + span, 128), np.int32)
                    np.cumsum(_signs(shingles[part[0] : part[-1] + span]), axis=0, out=sums[1:])
                    which, item = self.nearby(_blocks(sums[span:] - sums[:-span]))
                    for w, i in zip((part[0] + which).tolist(), item.tolist(), strict=True):
                        if self.sizes[i] == size:
                            found = (weighted_similarity(shingles[w : w + span], self.shingles[i]), -w)
                            if found[0] >= threshold and found > best.get(i, (0.0, 0)):
                                best[i] = found
        return [(i, similarity, -start) for i, (similarity, start) in sorted(best.items())]

    def found_in(self, texts: list[bytes], threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
        """``(text, item, similarity, first word, words)``."""
        if not self.ids:
            return
        words = find_words(texts, PUNCTUATION, lower=True)
        hashes = words.hashes()
        shingles = _shingles(hashes)
        maybe = np.concatenate([[0], np.cumsum(self.filter[shingles & np.uint64((1 << 20) - 1)])])
        for i in range(len(texts)):
            begin, end = words.first[i], words.first[i + 1] - SHINGLE + 1
            if end > begin and maybe[end] > maybe[begin]:
                for item, similarity, start in self.matches(shingles[begin:end], threshold):
                    yield i, item, similarity, start, min(int(self.sizes[item]), int(words.first[i + 1] - begin))


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block: int = ITEM_BLOCK) -> Iterator[Items]:
    """The items in parts of about ``block``, as many as it takes."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    parts = -(-items.count() // block)
    for part in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in chosen], [r["text"] for r in chosen])


def _leaks(items: Items, threshold: float, schema: pa.Schema):
    def leaks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(items.found_in(texts_of(batch), threshold))
            which = pa.array([f[0] for f in found], pa.int64())
            columns = [
                batch.column("doc_id").take(which),
                pa.array([items.ids[f[1]] for f in found], schema.field("item_id").type),
                pa.array([f[2] for f in found], pa.float64()),
                pa.array([f[3] for f in found], pa.int64()),
                pa.array([f[4] for f in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return leaks


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", threshold: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words``: the best window of each document for each item it contains."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = dict(rows.dtypes)["doc_id"], dict(benchmark.dtypes)[item_id]
    said = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word long, n_words long"
    result = docs.sparkSession.createDataFrame([], said)
    arrow = result.toArrow().schema
    before = None
    for items in item_blocks(benchmark, item_id):
        if before is not None:
            # with several blocks, only one is on the driver at a time
            result = result.unionByName(materialize(before, "leaks"))
        before = rows.mapInArrow(_leaks(items, threshold, arrow), said)
    return result if before is None else result.unionByName(before)


def without_leaks(docs: DataFrame, items: Items, text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text contains none of the items; rows pass in slices, as Arrow holds them."""

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            clean = np.ones(batch.num_rows, bool)
            clean[[f[0] for f in items.found_in(texts_of(batch, text), threshold)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(kept, docs.schema)
