"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs. The vector of an n-gram binds (multiplies) the vectors of its
letters, each rotated by its place from the end; a text's vector bundles (adds) those of its n-grams, and a language's
prototype those of its texts. A text's language is the prototype of largest cosine, the first by name on a tie, and
the score is that cosine, at least 0.

N-grams are counted first, for a few hundred texts or one piece of a long text at a time, and the counts multiply the
vectors of the n-grams, block by block; vectors are kept for the next texts up to a fixed number. Pieces of a long text
overlap where n-grams cross them and are added, so memory does not depend on the length of a text nor on the number of
short ones: about 250 MB a worker, besides the texts themselves. Runs of characters that are no letters count as one blank; letters are
lower-cased. Each task adds its texts per language, so training sends one vector per language and task.

A null text, and one without letters, is ``und`` with score 0, and so is every text if there is nothing to learn from.
Rows with a null language teach nothing. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.words import slices

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
SEED = 7
_SLICE = 1 << 19
#: Characters and texts that are counted at a time, and n-grams whose vectors are multiplied at a time.
_PIECE = 1 << 17
_TEXTS = 512
_BLOCK = 4_096
#: Letters whose vectors a task keeps.
_LETTERS = 20_000
#: n-gram vectors that a task keeps; the matrix starts anew beyond them.
_KEPT = 24_000


def _letters_of(points: np.ndarray) -> np.ndarray:
    """For each code point, itself if it is a letter, else 0 (the blank)."""
    present = np.flatnonzero(np.bincount(points))
    number = np.zeros(int(present[-1]) + 1, np.int64)
    number[present] = [p if chr(p).isalpha() else 0 for p in present.tolist()]
    return number[points]


def _letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """The sign vectors of letters; each depends on its letter and ``SEED`` only."""
    return np.stack([np.random.default_rng([SEED, int(p)]).integers(0, 2, dimensions, np.int8) * 2 - 1 for p in points])


class Profiles:
    """Vectors of n-grams, kept from one batch to the next."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram = dimensions, gram
        self.letters: dict[int, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.int64)
        self.rows = np.zeros(0, np.int64)
        self.matrix = np.zeros((0, self.dimensions), np.float32)

    def _letter_rows(self, points: np.ndarray) -> np.ndarray:
        if len(self.letters) > _LETTERS:
            self.letters = {}
        for p in points.tolist():
            if p not in self.letters:
                self.letters[p] = _letter_vectors(np.array([p]), self.dimensions)[0]
        return np.stack([self.letters[p] for p in points.tolist()])

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of sorted n-gram keys (21 bits for each letter)."""
        if len(self.keys) + len(keys) > _KEPT:
            self._forget()
        new = keys[~np.isin(keys, self.keys, assume_unique=True)]
        if len(new):
            bound = np.ones((len(new), self.dimensions), np.int8)
            for place in range(self.gram):
                points, which = np.unique((new >> (21 * place)) & ((1 << 21) - 1), return_inverse=True)
                bound *= np.roll(self._letter_rows(points), place, axis=1)[which]
            rows = np.concatenate([self.rows, len(self.rows) + np.arange(len(new))])
            self.matrix = np.concatenate([self.matrix, bound.astype(np.float32)])
            order = np.argsort(merged := np.concatenate([self.keys, new]))
            self.keys, self.rows = merged[order], rows[order]
        return self.matrix[self.rows[np.searchsorted(self.keys, keys)]]

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted n-gram keys, each text's counts of them, and which texts have letters."""
        lowered = [(t or "").lower() for t in texts]
        points = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts) + 1), [1, *[len(t) + 1 for t in lowered]]) - 1
        owner[0] = 0
        letters = _letters_of(points)
        has = np.zeros(len(texts), bool)
        has[owner[letters > 0]] = True
        # a blank before and after each text, and one for a run of other characters
        keep = np.ones(len(letters), bool)
        keep[1:] = (letters[1:] > 0) | (letters[:-1] > 0)
        letters, owner = letters[keep], owner[keep]
        n = len(letters) - self.gram + 1
        if n <= 0 or not has.any():
            return np.zeros(0, np.int64), np.zeros((len(texts), 0), np.float32), has
        present = np.unique(letters)
        compact = np.searchsorted(present, letters)
        code = np.zeros(n, np.int64)
        for place in range(self.gram):
            code = code * len(present) + compact[place : place + n]
        # a blank that ends one text begins the next; such n-grams count for the text of their middle
        owner = owner[self.gram // 2 : self.gram // 2 + n]
        inner = np.ones(n, bool)
        if self.gram > 2:
            inner = ~np.logical_or.reduce([letters[p : p + n] == 0 for p in range(1, self.gram - 1)])
        code, owner = code[inner], owner[inner]
        if len(present) ** self.gram <= 1 << 20:
            used = np.flatnonzero(np.bincount(code, minlength=len(present) ** self.gram))
        else:
            used = np.unique(code)
        column = np.searchsorted(used, code) if len(present) ** self.gram > 1 << 20 else _rank(used, len(present) ** self.gram)[code]
        table = np.bincount(owner * len(used) + column, minlength=len(texts) * len(used)).reshape(len(texts), len(used))
        keys, rest = np.zeros(len(used), np.int64), used.copy()
        for place in range(self.gram):
            keys |= present[rest % len(present)] << (21 * place)
            rest //= len(present)
        order = np.argsort(keys)
        return keys[order], table[:, order].astype(np.float32), has

    def _windows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted n-gram keys of one sequence of letters and blanks, and their counts in one row."""
        n = len(codes) - self.gram + 1
        keys = np.zeros(max(n, 0), np.int64)
        for place in range(self.gram):
            # the last letter has the lowest bits
            keys |= codes[self.gram - 1 - place : self.gram - 1 - place + len(keys)] << (21 * place)
        for place in range(1, self.gram - 1):
            keys = keys[(keys >> (21 * place)) & ((1 << 21) - 1) > 0] if len(keys) else keys
        found, times = np.unique(keys, return_counts=True)
        return found, times[None, :].astype(np.float32)

    def _of_long(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Keys, counts and whether there are letters, of each piece of a lower-cased text."""
        carried = np.zeros(0, np.int64)
        for at in range(0, len(text) + 1, _PIECE):
            part = text[at : at + _PIECE]
            said = (" " if at == 0 else "") + part + (" " if at + _PIECE > len(text) else "")
            codes = _letters_of(np.frombuffer(said.encode("utf-32-le", "surrogatepass"), np.uint32))
            keep = codes > 0
            keep[1:] |= codes[:-1] > 0
            keep[0] |= not len(carried) or carried[-1] > 0
            codes = np.concatenate([carried, codes[keep]])
            keys, table = self._windows(codes)
            yield keys, table, bool((codes > 0).any())
            carried = codes[max(len(codes) - self.gram + 1, 0) :]

    def tables(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Which texts, sorted n-gram keys, the texts' counts of them, and which have letters; a long text comes piece by piece."""
        group, size = [], 0
        for i, text in enumerate(texts):
            length = len(text or "")
            if group and (size + length > _PIECE or len(group) == _TEXTS):
                yield (np.array(group), *self.counts([texts[j] for j in group]))
                group, size = [], 0
            if length > _PIECE:
                for keys, table, has in self._of_long(text.lower()):
                    yield np.array([i]), keys, table, np.array([has])
            else:
                group.append(i)
                size += length
        if group:
            yield (np.array(group), *self.counts([texts[j] for j in group]))

    def added(self, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The sums of the keys' vectors, as often as each row of ``table`` counts them."""
        total = np.zeros((len(table), self.dimensions), np.float32)
        for at in range(0, len(keys), _BLOCK):
            total += table[:, at : at + _BLOCK] @ self.vectors(keys[at : at + _BLOCK])
        return total

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' vectors, and which texts have letters."""
        total, letters = np.zeros((len(texts), self.dimensions), np.float32), np.zeros(len(texts), bool)
        for which, keys, table, has in self.tables(texts):
            total[which] += self.added(table, keys)
            letters[which] |= has
        return total, letters


def _rank(used: np.ndarray, size: int) -> np.ndarray:
    rank = np.zeros(size, np.int64)
    rank[used] = np.arange(len(used))
    return rank


def _learn(dimensions: int, gram: int):
    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dimensions, gram), {}
        for batch in slices(batches, size=_SLICE, rows=_TEXTS):
            all_langs = batch.column("lang").to_pylist()
            for which, keys, table, _ in profiles.tables(batch.column("text").to_pylist()):
                langs = [all_langs[i] for i in which.tolist()]
                names = sorted({*langs})
                member = np.array([[lang == name for lang in langs] for name in names], np.float32)
                for name, vector in zip(names, profiles.added(member @ table, keys), strict=True):
                    sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        names = list(sums)
        at = pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(names)))
        values = np.concatenate([sums[n] for n in names]) if names else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, dimensions).tolist(), pa.string()), at, pa.array(np.rint(values).astype(np.int64))], names=["lang", "dimension", "total"])

    return learn


def learn_prototypes(texts: DataFrame, dimensions: int = DIMENSIONS, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The bundled vector of each language of ``texts`` (``text, lang``); as large as the number of languages."""
    known = texts.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    sums = known.mapInArrow(_learn(dimensions, gram), "lang string, dimension int, total long").groupBy("lang", "dimension").agg(F.sum("total").alias("total"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dimension", "total"))).alias("vector")).collect()
    return {r["lang"]: np.array([x["total"] for x in r["vector"]], np.float64) for r in rows}


def identify(prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, gram: int = GRAM):
    """A function on a text column that gives a struct of ``lang_pred`` and ``score``."""
    names = sorted(n for n, v in prototypes.items() if np.any(v))
    matrix = np.stack([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]).astype(np.float32) if names else None

    profiles = Profiles(dimensions, gram)

    def predicted(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if matrix is None:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bundles, has = profiles.bundles(texts)
        norms = np.linalg.norm(bundles, axis=1)
        cosines = (bundles @ matrix.T) / np.where(norms > 0, norms, 1)[:, None]
        best = cosines.argmax(axis=1)
        score = np.where(has, np.clip(cosines.max(axis=1), 0, 1), 0).astype(np.float64)
        return [names[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], score

    return predicted


def _predict(prototypes: dict[str, np.ndarray], dimensions: int, gram: int):
    predicted = identify(prototypes, dimensions, gram)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=_SLICE, rows=_TEXTS):
            names, score = predicted(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return predict


def predict_languages(docs: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, gram: int = GRAM) -> DataFrame:
    """``doc_id, lang_pred, score`` of all ``docs``, learned from the rows for which ``learn_from`` holds."""
    prototypes = learn_prototypes(docs.where(learn_from).select(F.col(text).alias("text"), F.col(lang).alias("lang")), dimensions, gram)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_predict(prototypes, dimensions, gram), f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")
