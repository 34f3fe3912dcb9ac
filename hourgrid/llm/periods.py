"""Periodic runs of words by descending-LCP Kruskal, document by document.

A run is a stretch of words with smallest period q, of at least ``least_words`` words and ``least_periods`` periods, that
no neighbouring word extends.

1. Two suffixes of a text, q words apart in a run, share a prefix of all its words but q. So only suffixes whose first
   ``least_words - least_words // least_periods`` words begin another suffix of the text can seed a run; most texts have none.
2. These suffixes are sorted by prefix doubling, and the longest common prefix (LCP) of neighbours is found by halving
   lengths of equal hashes.
3. Neighbours are united by decreasing LCP, as Kruskal's algorithm takes edges. A class is a range of the sorted suffixes,
   found by its ends, with the ordered set of its positions; the smaller set goes into the larger. Two positions that
   become neighbours in the united set, at a distance within the LCP, seed a run with that distance as its period.
4. Seeds are extended both ways; of the periods that one stretch shows, the smallest is its own.

Runs of a text are found by one task, which sees the whole text: memory is about 100 bytes a word of the longest text
or of 2 MB of texts, whichever is more. Nothing is shuffled. Words are compared by 64-bit hashes, stretches by hashes
modulo two primes.

A null, empty or blank text has no words and no runs; repeated rows give their runs again; two runs may overlap, and
both count; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.words import find_words, mixed, slices, texts_of

LEAST_WORDS = 24
LEAST_PERIODS = 3
RUN = "struct<start: bigint, length: bigint, period: bigint>"


#: Two primes below 2^31, and a base for each. Modulo 2^64 the two halves of a Thue-Morse sequence would be equal.
PRIMES = np.array([2147483647, 2147483629], np.uint64)
BASES = (1_000_003_769, 1_300_000_021)
_tables = [np.ones((2, 1), np.uint64), np.ones((2, 1), np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """``n`` powers at least, and inverse powers, of both bases."""
    if _tables[0].shape[1] < n:
        for t, sign in enumerate((1, -1)):
            table = _tables[t]
            while table.shape[1] < n:
                size = table.shape[1]
                factor = np.array([[pow(b, sign * size, int(p))] for b, p in zip(BASES, PRIMES, strict=True)], np.uint64)
                table = np.concatenate([table, table * factor % PRIMES[:, None]], axis=1)
            _tables[t] = table
    return _tables


class Prefixes:
    """Hashes of any stretch of a sequence of codes, from running sums modulo both primes."""

    def __init__(self, codes: np.ndarray):
        power, inverse = _powers(len(codes) + 1)
        self.inverse = inverse
        self.sums = np.zeros((2, len(codes) + 1), np.uint64)
        for i, part in enumerate((codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF))):
            # below 2^31 each, so that sums of 2^33 words fit
            np.cumsum((part + np.uint64(1)) % PRIMES[i] * power[i, : len(codes)] % PRIMES[i], out=self.sums[i, 1:])
            self.sums[i] %= PRIMES[i]

    def of(self, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        first, second = ((s[starts + length] + p - s[starts]) * i[starts] % p for s, i, p in zip(self.sums, self.inverse, PRIMES, strict=True))
        return first << np.uint64(32) | second

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, backward: bool = False) -> np.ndarray:
        """How many words, ``most`` at most, are equal from ``a`` and ``b`` on, or before them."""
        length = np.zeros(len(a), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            fits = np.flatnonzero(length + step <= most)
            x, y = (p[fits] - length[fits] - step if backward else p[fits] + length[fits] for p in (a, b))
            length[fits[self.of(x, step) == self.of(y, step)]] += step
            step >>= 1
        return length


def folded(first: np.ndarray, folds: list[int | None]) -> np.ndarray:
    """The word that stands at each place: texts with a fold ``g`` repeat the ``p`` words from ``a`` on up to their end.

    Of n words, ``a`` is ``g % n`` and ``p`` is ``1 + (n - a) // (3 + g % 8)``.
    """
    place = np.arange(first[-1])
    for i, g in enumerate(folds):
        n = int(first[i + 1] - first[i])
        if g is not None and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            place[first[i] + a : first[i + 1]] = first[i] + a + np.arange(n - a) % p
    return place


def repeated_windows(prefixes: Prefixes, first: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows of ``size`` words that occur again in their text."""
    windows = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(windows)), windows)
    starts = np.arange(len(owner)) + (first[:-1] - np.cumsum(windows) + windows)[owner]
    keys = mixed(prefixes.of(starts, size)) ^ mixed(owner.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return starts[:0]
    return starts[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]


def sorted_suffixes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of ``codes`` in the order of their suffixes; the stretch of place ``i`` ends before ``ends[i]``.

    Suffixes end with their stretch in a mark of its own. Ranks double the length that they tell apart, and only
    places whose rank is shared are sorted again.
    """
    n = len(codes)
    _, rank = np.unique(codes, return_inverse=True)
    starts_of = np.concatenate([[0], np.cumsum(np.bincount(rank))])
    rank = starts_of[rank]
    size, active = 1, np.flatnonzero(np.bincount(rank, minlength=n + 1)[rank] > 1)
    while len(active):
        after = active + size
        inside = after < ends[active]
        # a suffix that is over differs from all others, in the order of its stretch
        following = np.where(inside, rank[np.minimum(after, n - 1)] + n, np.minimum(ends[active], n) - 1)
        key = rank[active] * (2 * n + 1) + following
        order = np.argsort(key, kind="stable")
        placed, key = active[order], key[order]
        at = np.arange(len(placed))
        old = rank[placed]
        new_key = np.append(True, key[1:] != key[:-1])
        new_rank = np.append(True, old[1:] != old[:-1])
        key_start = np.maximum.accumulate(np.where(new_key, at, 0))
        rank[placed] = old + key_start - np.maximum.accumulate(np.where(new_rank, at, 0))
        # several suffixes of one stretch that are over at once have different lengths, and so did their ranks
        active = placed[~(new_key & np.append(new_key[1:], True))]
        size *= 2
    return np.argsort(rank, kind="stable")


def unite(positions: list[int], joints: list[int], lcps: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs of positions that become neighbours, at a distance within the LCP, as classes are united.

    ``positions`` are in the order of their suffixes; joint ``k`` unites the classes of ``positions[k]`` and
    ``positions[k + 1]``; ``lcps``, one for each joint, do not increase.
    """
    begin, end = list(range(len(positions))), list(range(len(positions)))
    members: list[list[int]] = [[p] for p in positions]
    for k, lcp in zip(joints, lcps, strict=True):
        low, high = begin[k], end[k + 1]
        small, large = members[low], members[k + 1]
        if len(small) > len(large):
            small, large = large, small
        gap, last = -1, 0
        for x in small:
            at = bisect_left(large, x, max(gap, 0))
            if at != gap:
                if gap >= 0 and large[gap] - last <= lcp:
                    yield last, large[gap]
                if at and x - large[at - 1] <= lcp:
                    yield large[at - 1], x
                gap = at
            last = x
            if gap == len(large):
                break
        if gap < len(large) and large[gap] - last <= lcp:
            yield last, large[gap]
        if 16 * len(small) < len(large):
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
        members[low], members[k + 1] = large, large if low == k + 1 else []
        begin[high], end[low] = low, high


def runs_of(codes: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, ...]:
    """``text, start, length, period`` of the runs of texts ``codes[first[i]:first[i + 1]]``, by text, start and period."""
    least = least_words - least_words // least_periods
    prefixes = Prefixes(codes)
    seen = repeated_windows(prefixes, first, least)
    if not len(seen):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    # the words of repeated windows, in stretches
    edges = np.zeros(len(codes) + 1, np.int64)
    edges[seen] += 1
    np.add.at(edges, seen + least, -1)
    covered = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
    text = np.searchsorted(first, covered, "right") - 1
    breaks = np.append((np.diff(covered) > 1) | (np.diff(text) > 0), True)
    stretch_ends = np.flatnonzero(breaks) + 1
    ends = stretch_ends[np.searchsorted(stretch_ends, np.arange(len(covered)), "right")]
    order = sorted_suffixes(codes[covered] ^ mixed(text.astype(np.uint64) + np.uint64(1)), ends)

    a, b = covered[order[:-1]], covered[order[1:]]
    joints = np.flatnonzero(text[order[:-1]] == text[order[1:]])
    stop = first[text[order] + 1]
    joints = joints[np.maximum(a, b)[joints] + least <= stop[joints]]
    joints = joints[prefixes.of(a[joints], least) == prefixes.of(b[joints], least)]
    lcp = prefixes.common(a[joints], b[joints], stop[joints] - np.maximum(a, b)[joints])
    falling = np.argsort(-lcp, kind="stable")
    seeds = np.array(list(unite(covered[order].tolist(), joints[falling].tolist(), lcp[falling].tolist())), np.int64).reshape(-1, 2)

    at, period = seeds[:, 0], seeds[:, 1] - seeds[:, 0]
    text = np.searchsorted(first, at, "right") - 1
    left = prefixes.common(at, at + period, at - first[text], backward=True)
    right = prefixes.common(at, at + period, first[text + 1] - at - period)
    start, length = at - left, left + period + right
    keep = (length >= least_words) & (length >= least_periods * period)
    text, start, length, period = text[keep], start[keep] - first[text[keep]], length[keep], period[keep]
    order = np.lexsort((period, length, start, text))
    text, start, length, period = text[order], start[order], length[order], period[order]
    # one stretch shows multiples of its period too
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, period = text[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _collapsed(words: list[bytes], place: np.ndarray, runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats: all but its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = place[np.cumsum(edges[:-1]) == 0]
    return b" ".join([words[p] for p in kept.tolist()])


def _find(least_words: int, least_periods: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, folds = texts_of(batch), batch.column("fold").to_pylist()
            words = find_words(texts)
            place = folded(words.first, folds)
            text, start, length, period = runs_of(words.hashes()[place], words.first, least_words, least_periods)
            ends = np.searchsorted(text, np.arange(len(texts) + 1))
            runs = [list(zip(*(c[a:b].tolist() for c in (start, length, period)), strict=True)) for a, b in zip(ends, ends[1:], strict=False)]
            collapsed = []
            for i, (raw, found) in enumerate(zip(texts, runs, strict=True)):
                # bytes.split() parts at the same characters as the words here
                own = raw.split()
                if found or folds[i] is not None:
                    collapsed.append(_collapsed(own, place[words.first[i] : words.first[i + 1]] - words.first[i], found))
                else:
                    collapsed.append(b" ".join(own))
            run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            arrays = [
                batch.column("doc_id"),
                pa.array(np.diff(words.first), pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs], pa.list_(run_type)),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "collapsed"])

    return find


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: Column | None = None, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row.

    ``runs`` are all runs by start, then period, in word numbers from 0. ``collapsed`` is the text, its words joined by one
    space, without the words that any run contains after its first period. Where ``fold`` is a number and not null, the
    text is read as ``folded`` says.
    """
    if least_periods < 2 or least_words < least_periods:
        raise ValueError("a run has at least two periods, of a word or more")
    fold = F.lit(None) if fold is None else fold
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"), fold.cast("long").alias("fold"))
    return rows.mapInArrow(_find(least_words, least_periods), f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, runs array<{RUN}>, collapsed string")


def highest_exponent(runs: Column) -> Column:
    """The run of greatest length over period, exactly compared; of equal ones the first, null without runs."""
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, run: F.when(better(best, run), run).otherwise(best))


def runs_text(runs: Column) -> Column:
    """A line ``start,length,period`` for each run, every one ended by a line feed."""
    lines = F.transform(runs, lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    return F.concat(F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise(""))
