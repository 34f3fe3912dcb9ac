"""Words, their 64-bit hashes and hashes of word sequences, for whole Arrow batches at a time.

A word is a run of bytes of the UTF-8 text between separators. All hashes are polynomials modulo 2^64 over random
byte codes, finished by a mixing step; equal sequences have equal hashes in every task and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are hashed at a time; memory per task is a small multiple of it plus the longest text.
SLICE_BYTES = 1 << 20
_BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64)

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and the bytes of other characters.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]

_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), _BLOCK)
        for name, base in (("_powers", _BASE), ("_inverse_powers", _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            globals()[name] = np.cumprod(table, dtype=np.uint64)
    return _powers, _inverse_powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which high and low bits are equally random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of ``codes[start:end]`` for each start and end."""
    power, inverse = _power_tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[: len(codes)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _long_word(codes: np.ndarray, raw: np.ndarray) -> np.uint64:
    total, factor = 0, 1
    step = pow(_BASE, _BLOCK, 1 << 64)
    power, _ = _power_tables(_BLOCK)
    for at in range(0, len(raw), _BLOCK):
        part = codes[raw[at : at + _BLOCK]]
        total = (total + int(np.sum(part * power[: len(part)], dtype=np.uint64)) * factor) % (1 << 64)
        factor = factor * step % (1 << 64)
    return mixed(np.array([(total + len(raw)) % (1 << 64)], np.uint64))[0]


@dataclass
class Words:
    """Words of several texts: those of text ``i`` are ``first[i]`` to ``first[i + 1] - 1``."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    lower: bool = False

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """A hash for each word, or for its first ``prefix`` bytes; words shorter than that hash as they are."""
        codes, ends = _LOWER_CODES if self.lower else _CODES, self.ends
        if prefix is not None:
            ends = np.minimum(ends, self.starts + prefix)
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            origin = self.starts[at]
            to = max(at + 1, int(np.searchsorted(ends, origin + _BLOCK, "right")))
            if ends[to - 1] - origin > _BLOCK:
                out[at] = _long_word(codes, self.raw[origin : ends[at]])
            else:
                out[at:to] = run_hashes(codes[self.raw[origin : ends[to - 1]]], self.starts[at:to] - origin, ends[at:to] - origin)
            at = to
        return out

    def owner(self) -> np.ndarray:
        """The number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, word: int) -> bytes:
        return self.raw[self.starts[word] : self.ends[word]].tobytes()


def find_words(texts: list[bytes], separators: np.ndarray = WHITESPACE, lower: bool = False) -> Words:
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    gap = separators[raw]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)]) + 1
    return Words(raw, starts, ends, np.searchsorted(starts, offsets[: len(texts) + 1]), lower)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [b if b is not None else b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``size`` bytes of text and, if given, at most ``rows`` rows, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + size, "right")))
            to = min(to, at + (rows or to))
            yield batch.slice(at, to - at)
            at = to


def sequence_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size`` consecutive words of one text, and the text each belongs to.

    A text with words, but fewer than ``size``, counts as one sequence; one without words has none.
    """
    count = np.diff(first)
    sequences = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), sequences)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(sequences) - sequences, sequences)
    starts = first[owner] + within
    return run_hashes(hashes, starts, np.minimum(starts + size, first[owner + 1])), owner
