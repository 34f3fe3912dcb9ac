"""Quality classification by co-training of two views of a document.

The content view sees measures of the text: repetition, symbols, capitals, word lengths, lines. The metadata view sees
what the table says about the page: its source, language and length. Each has a logistic regression, calibrated on the
labelled rows by cross-fitting. In every round each view names all unlabelled rows that it is at least ``SURE`` of, and
the other view is fitted again on them and on the labelled rows. What is named counts at most as much as the labelled
rows do, in their shares of the classes; a view that is sure of one class only, or of no row, names none. At the end both
calibrated views add up: the sum of their log odds less the prior's, calibrated once more.

Texts are measured once, into a narrow table of all documents. Each Newton step of a round is one pass over that table:
tasks add gradients and curvatures of both views, for every fold at once, and only the sums reach the driver. Labelled
rows are bounded: at most ``SAMPLE`` of them, chosen by a hash, are learned from.

A null or empty text has measures of 0; null metadata is a value of its own; a long text is measured as a whole; repeated
rows count as often as they occur; an empty table gives an empty result. Without labels of both classes every score is
the share of good labels, or one half.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.linear import added, calibration, fit_logistic, logits, newton_step, newton_sums, sigmoid
from hourgrid.llm.samples import labelled_ids
from hourgrid.llm.words import find_words, slices, texts_of
from hourgrid.session import materialize

SAMPLE = 12_000
ROUNDS = 4
#: Newton steps of a round, from the weights of the one before.
STEPS = 6
SURE = 0.97
FOLDS = 4
METADATA_HASHES = 64
CONTENT = 13


def content_measures(texts: list[bytes]) -> np.ndarray:
    """Measures of texts, most of them shares; empty texts have zeros."""
    words = find_words(texts)
    n, count = len(texts), np.diff(words.first)
    owner = words.owner()
    raw = words.raw
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) + 1
    begins = np.concatenate([[1], ends[:-1]])

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[ends - 1] - total[begins]

    length = np.maximum(ends - 1 - begins, 1)
    upper, lower = share((raw >= 65) & (raw <= 90)), share((raw >= 97) & (raw <= 122))
    symbols = share((raw < 128) & (raw > 32) & ~(((raw >= 48) & (raw <= 57)) | ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122)) | np.isin(raw, [44, 46, 39, 45])))
    digits, breaks = share((raw >= 48) & (raw <= 57)), share(raw == 10)
    hashes = words.hashes()
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner[same], minlength=n)
    order = np.lexsort((hashes, owner))
    sorted_hashes, sorted_owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (sorted_hashes[1:] != sorted_hashes[:-1]) | (sorted_owner[1:] != sorted_owner[:-1])
    distinct = np.bincount(sorted_owner[new], minlength=n)
    sizes = np.diff(np.append(np.flatnonzero(new), len(hashes)))
    commonest = np.zeros(n)
    np.maximum.at(commonest, sorted_owner[new], sizes)
    letters = words.ends - words.starts
    mean = np.bincount(owner, letters, n) / np.maximum(count, 1)
    single = np.bincount(owner[letters == 1], minlength=n)
    safe = np.maximum(count, 1)
    columns = [
        np.log1p(count), mean, repeats / safe, distinct / safe, commonest / safe, single / safe, symbols / length, np.log1p(1000 * symbols / length),
        upper / np.maximum(upper + lower, 1), digits / length, np.log1p(1000 * breaks / length), np.log1p(100 * repeats / safe), distinct / np.sqrt(safe),
    ]
    return np.where((count > 0)[:, None], np.column_stack(columns), 0.0)


def metadata_places(source: list, lang: list) -> np.ndarray:
    """Where the one-hot entries of source and language are, by row."""
    places = np.zeros((len(source), 2), np.int64)
    for at, (column, values) in enumerate((("source", source), ("lang", lang))):
        text = [f"{column} {'null' if v is None else 'is ' + v}".encode("utf-8", "surrogatepass").replace(b" ", b"_") for v in values]
        words = find_words(text)
        places[:, at] = words.hashes()[words.first[:-1]] % np.uint64(METADATA_HASHES)
    return places


def metadata_measures(places: np.ndarray, n_chars: list) -> np.ndarray:
    """One-hot source and language, and the length as the table gives it."""
    out = np.zeros((len(places), METADATA_HASHES + 3))
    for place in places.T:
        out[np.arange(len(places)), place] += 1
    known = np.array([v is not None for v in n_chars], bool)
    size = np.log1p(np.maximum(np.array([v or 0 for v in n_chars], float), 0))
    out[:, -3], out[:, -2], out[:, -1] = size, size**2 / 10, known
    return out


MEASURED = "content binary, source int, lang int, n_chars long"


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        content = content_measures(texts_of(batch)).astype(np.float32)
        places = metadata_places(*(batch.column(c).to_pylist() for c in ("source", "lang"))).astype(np.int32)
        arrays = [batch.column("doc_id"), pa.array([r.tobytes() for r in content], pa.binary()), *map(pa.array, places.T.copy()), batch.column("n_chars")]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "content", "source", "lang", "n_chars"])


def _views_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The content rows and the metadata rows of measured documents."""
    content = np.frombuffer(b"".join(batch.column("content").to_pylist()), np.float32).reshape(-1, CONTENT).astype(np.float64)
    places = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("source", "lang")]).reshape(-1, 2)
    return content, metadata_measures(places, batch.column("n_chars").to_pylist())


@dataclass
class View:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * logits((x - self.mean) / self.spread, self.weights) + self.offset

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x - self.mean) / self.spread, np.ones((len(x), 1))], axis=1)


@dataclass
class Classifier:
    views: tuple[View, ...]
    prior: float
    slope: float
    offset: float
    exchanged: list[tuple[int, int]]

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        if not self.views:
            return np.full(len(content), self.prior)
        both = sum(v.logit(x) for v, x in zip(self.views, (content, metadata), strict=True)) - np.log(self.prior / (1 - self.prior))
        return sigmoid(self.slope * both + self.offset)


def named_by(view: View, x: np.ndarray) -> np.ndarray:
    """1 and 0 where a view is sure of a class, -1 elsewhere."""
    p = sigmoid(view.logit(x))
    return np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1))


def _counts(views: tuple[View, View], rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many rows each view names good, and bad."""
    return np.array([[(named == 1).sum(), (named == 0).sum()] for named in (named_by(v, x) for v, x in zip(views, rows, strict=True))])


def _sums_of(views: tuple[View, View], fits: list[np.ndarray], shares: list[np.ndarray | None], rows: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray | None]:
    """Sums for the fits of each view over what the other one names; ``shares`` weigh bad and good rows."""
    sums = []
    for k in range(2):
        if shares[k] is None:
            sums.append(None)
            continue
        named = named_by(views[1 - k], rows[1 - k])
        sure = named >= 0
        sums.append(newton_sums(views[k].inputs(rows[k][sure]), named[sure].astype(float), shares[k][named[sure]], fits[k]))
    return sums


class Rows:
    """Unlabelled rows in memory."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray]):
        self.views = views

    def counts(self, views: tuple[View, View]) -> np.ndarray:
        return _counts(views, self.views)

    def sums(self, *of) -> list[np.ndarray | None]:
        return _sums_of(*of, self.views)


class Table:
    """Unlabelled rows of a measured table; every question is one pass over all of them."""

    def __init__(self, measured: DataFrame):
        self.measured = measured

    def counts(self, views: tuple[View, View]) -> np.ndarray:
        found = added(self.measured, lambda batch: list(_counts(views, _views_of(batch)).astype(float)), 2)
        return np.array([np.zeros(2) if f is None else f for f in found])

    def sums(self, views: tuple[View, View], fits: list[np.ndarray], shares: list[np.ndarray | None]) -> list[np.ndarray | None]:
        found = added(self.measured, lambda batch: [None if s is None else s.ravel() for s in _sums_of(views, fits, shares, _views_of(batch))], 2)
        return [None if f is None else f.reshape(len(w), -1) for f, w in zip(found, fits, strict=True)]


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool, rounds: int = ROUNDS) -> Classifier:
    """``labelled`` holds the content rows and the metadata rows, ``pool`` the unlabelled ones: both likewise, or a ``Table``."""
    if len({*y.tolist()}) < 2:
        return Classifier((), float(y.mean()) if len(y) else 0.5, 1.0, 0.0, [])
    pool = Rows(pool) if isinstance(pool, tuple) else pool
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    fold = np.arange(len(y)) % FOLDS
    # a fit without each fold, which says what it thinks of that fold, and one on all rows
    parts = [fold != k for k in range(FOLDS)] + [np.ones(len(y), bool)]
    exchanged: list[tuple[int, int]] = []

    def view(k: int, fits: np.ndarray) -> View:
        mean, spread = labelled[k].mean(axis=0), np.maximum(labelled[k].std(axis=0), 1e-6)
        x = (labelled[k] - mean) / spread
        unseen = np.zeros(len(y))
        for f in range(FOLDS):
            unseen[fold == f] = logits(x[fold == f], fits[f])
        return View(mean, spread, fits[-1], *calibration(unseen, y))

    def alone(k: int) -> np.ndarray:
        x = (labelled[k] - labelled[k].mean(axis=0)) / np.maximum(labelled[k].std(axis=0), 1e-6)
        return np.stack([fit_logistic(x[part], y[part]) for part in parts])

    fits = [alone(0), alone(1)]
    views = (view(0, fits[0]), view(1, fits[1]))
    for _ in range(rounds):
        named = pool.counts(views)
        exchanged.append((int(named[0].sum()), int(named[1].sum())))
        shares: list[np.ndarray | None] = []
        for good, bad in named[::-1]:
            # in the classes' shares, and together at most as much as the labelled rows
            total = min(len(y), good / prior, bad / (1 - prior))
            shares.append(np.array([total * (1 - prior) / bad, total * prior / good]) if good and bad else None)
        if all(share is None for share in shares):
            break
        for _ in range(STEPS):
            sums = pool.sums(views, fits, shares)
            for k in range(2):
                if sums[k] is not None:
                    own = views[k].inputs(labelled[k])
                    fits[k] = np.stack([newton_step(w, found + newton_sums(own[part], y[part], np.ones(part.sum()), w[None])[0]) for w, found, part in zip(fits[k], sums[k], parts, strict=True)])
        views = (view(0, fits[0]), view(1, fits[1]))
    both = Classifier(views, prior, 1.0, 0.0, exchanged)
    p = both.score(*labelled)
    both.slope, both.offset = calibration(np.log(np.clip(p, 1e-12, 1) / np.clip(1 - p, 1e-12, 1)), y)
    return both


def fit(measured: DataFrame) -> Classifier:
    """``measured`` has the measures of all documents and their ``label``, if they are learned from."""
    known = measured.where("label IS NOT NULL").orderBy(F.xxhash64("content", "source", "lang", "n_chars")).limit(SAMPLE).toArrow()
    batch = known.combine_chunks().to_batches()
    labelled = _views_of(batch[0]) if batch else (np.zeros((0, CONTENT)), np.zeros((0, METADATA_HASHES + 3)))
    return co_train(labelled, np.array(known.column("label").to_pylist(), float), Table(measured.where("label IS NULL")))


def _score(classifier: Classifier):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(classifier.score(*_views_of(batch)))], names=["doc_id", "score"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> DataFrame:
    """``doc_id, score, keep`` of every row; the score is the chance of good quality, rows of one half or more are kept."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(n_chars).cast("long").alias("n_chars"))
    kind = dict(rows.dtypes)["doc_id"]
    ids = labelled_ids(labels.select("doc_id", "quality"), "quality", SAMPLE, learn_from)
    measured = materialize(rows.mapInArrow(_measure, f"doc_id {kind}, {MEASURED}").join(ids, "doc_id", "left"), "measured")
    scored = measured.mapInArrow(_score(fit(measured)), f"doc_id {kind}, score double")
    return scored.withColumn("keep", F.col("score") >= 0.5)
