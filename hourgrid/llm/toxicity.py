"""Toxicity by weak supervision.

1. Voters. A fixed lexicon, and words and word prefixes ("patterns") that the labelled sample shows mostly in toxic
   texts; each voter fires if its word or a word with its prefix occurs. Two more fire on several lexicon words, and on
   a high share of them.
2. Label model. Firing rates of each voter in toxic and in other texts, and the class of each text, are estimated by
   expectation maximisation, the rates starting from the labelled sample. The voters' correlation within a class says
   how many voices a voter shares its vote with; its weight is divided by that number.
3. Classifier. A logistic regression learns the posterior labels from voter counts and from hashed prefixes of all
   words, and its scores are calibrated on the labelled sample. It scores every whole text in one pass.

Voters are found in the documents of at most ``SAMPLE`` labelled ids, and models are fitted on at most ``FIT_ROWS`` of
them, both chosen by a hash. Labels enter only from rows for which ``learn_from`` holds.

Null, empty and very short texts score as a text without any voter. Without labelled documents of both classes the
lexicon alone scores. Repeated rows and ids count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.linear import calibration, fit_logistic, logits, sigmoid
from hourgrid.llm.samples import labelled_ids, with_labels
from hourgrid.llm.words import PUNCTUATION, Words, find_words, slices
from hourgrid.session import materialize

SAMPLE = 20_000
FIT_ROWS = 8_000
VOTERS = 192
HASHED = 384
PREFIXES = (4, 5, 6)
#: Texts that are counted at a time; each takes about 5 KB, however short it is.
SLICE_ROWS = 4_096
#: Voters found in the sample occur in at least so many toxic texts.
LEAST_TOXIC = 5
LABEL_ACCURACY = 0.95
#: Common insults of the languages the corpus has.
LEXICON = (
    "idiot idiots idiotic moron morons moronic stupid dumb imbecile fool loser losers scum trash garbage filth filthy vermin worthless pathetic "
    "disgusting clown clowns jerk creep freak coward liar bastard pig swine rat parasite subhuman degenerate "
    "dummkopf trottel abschaum wertlos widerlich arschloch idiota imbécil estúpido basura inútil asqueroso payaso "
    "imbécile crétin stupide ordure minable dégoûtant"
).split()


def _words(texts: list[str | None]) -> Words:
    return find_words([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts], PUNCTUATION)


def _features(words: Words) -> list[np.ndarray]:
    """Hashes of the whole words, and of their prefixes; a word shorter than a prefix has 0 there."""
    length = words.ends - words.starts
    kinds = [words.hashes()]
    kinds += [np.where(length >= n, words.hashes(n) + np.uint64(n), np.uint64(0)) for n in PREFIXES]
    return kinds


def _occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts of a slice each feature occurs."""
    for batch in slices(batches):
        words, label = _words(batch.column("text").to_pylist()), batch.column("label").to_numpy(zero_copy_only=False)
        owner = words.owner()
        for kind, feature in enumerate(_features(words)):
            used = np.flatnonzero(feature)
            used = used[np.lexsort((owner[used], feature[used]))]
            value, text = feature[used], owner[used]
            once = np.append(True, (value[1:] != value[:-1]) | (text[1:] != text[:-1]))[: len(used)]
            value, toxic = value[once], label[text[once]] == 1
            first = np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])
            if not len(first):
                continue
            in_toxic = np.add.reduceat(toxic.astype(np.int64), first)
            in_all = np.diff(np.append(first, len(value)))
            arrays = [pa.array(np.full(len(first), kind, np.int32)), pa.array(value[first].view(np.int64)), pa.array(in_toxic), pa.array(in_all - in_toxic)]
            yield pa.RecordBatch.from_arrays(arrays, names=["kind", "feature", "toxic", "other"])


def find_voters(sample: DataFrame, most: int = VOTERS) -> list[tuple[int, int]]:
    """``(kind, hash)`` of the words and prefixes that speak most for the toxic class."""
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return []
    seen = sample.select("text", "label").mapInArrow(_occurrences, "kind int, feature long, toxic long, other long")
    seen = seen.groupBy("kind", "feature").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).where(F.col("t") >= LEAST_TOXIC)
    odds = F.log((F.col("t") + 0.5) / (size[1] + 1.0)) - F.log((F.col("o") + 0.5) / (size[0] + 1.0))
    best = seen.withColumn("odds", odds).where("odds > 2").orderBy(F.desc(F.col("t") * F.col("odds")), "kind", "feature").limit(most)
    return [(r["kind"], r["feature"]) for r in best.collect()]


@dataclass
class Counter:
    """Counts of voters and hashed prefixes in texts; the lexicon's words come first."""

    voters: list[tuple[int, int]]

    def __post_init__(self):
        lexicon = find_words([" ".join(LEXICON).encode()], PUNCTUATION).hashes().view(np.int64)
        keys = [(0, int(h)) for h in lexicon] + [v for v in self.voters if v not in {(0, int(h)) for h in lexicon}]
        self.lexicon, self.size = len(lexicon), len(keys)
        self.tables = []
        for kind in range(len(PREFIXES) + 1):
            own = sorted((np.uint64(h & (1 << 64) - 1), i) for i, (k, h) in enumerate(keys) if k == kind)
            self.tables.append((np.array([h for h, _ in own], np.uint64), np.array([i for _, i in own], np.int64)))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Voter counts, hashed prefix counts, and numbers of words, by text."""
        words = _words(texts)
        owner, n = words.owner(), len(texts)
        features = _features(words)
        votes = np.zeros((n, self.size))
        for feature, (keys, index) in zip(features, self.tables, strict=True):
            if len(keys) and len(feature):
                place = np.minimum(np.searchsorted(keys, feature), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == feature)
                votes += np.bincount(owner[hit] * self.size + index[place[hit]], minlength=n * self.size).reshape(n, -1)
        prefix = features[2] % np.uint64(HASHED)
        hashed = np.bincount(owner * HASHED + prefix.astype(np.int64), minlength=n * HASHED).reshape(n, -1)
        return votes, hashed.astype(np.float64), np.diff(words.first)

    def inputs(self, votes: np.ndarray, hashed: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What the classifier sees: logarithms of voter counts, and the direction of the prefix counts."""
        norm = np.linalg.norm(hashed, axis=1)
        return np.concatenate([np.log1p(votes), hashed / np.maximum(norm, 1)[:, None]], axis=1)

    def firing(self, votes: np.ndarray, length: np.ndarray) -> np.ndarray:
        hits = votes[:, : self.lexicon].sum(axis=1)
        return np.column_stack([votes > 0, hits >= 2, hits > 0.01 * np.maximum(length, 1)]).astype(float)


def label_model(fires: np.ndarray, labels: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of the toxic class for each text, and the model's rates and shared voices.

    The model is a mixture of two classes with a firing rate for each voter in each. A voter that correlates with
    others inside the classes counts by one over the sum of its squared correlations. The label votes too, with the
    accuracy ``LABEL_ACCURACY``; without it, voters that never fire together would end up in different classes.
    """
    prior = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    said = np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)) * np.where(labels == 1, 1, -1)
    posterior = np.where(labels == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
    shared = np.ones(fires.shape[1])
    for _ in range(rounds):
        sums = np.stack([posterior, 1 - posterior])
        rates = (sums @ fires + 0.1) / (sums.sum(axis=1, keepdims=True) + 0.2)
        rest = fires - (posterior[:, None] * rates[0] + (1 - posterior)[:, None] * rates[1])
        spread = np.sqrt(np.maximum((rest**2).mean(axis=0), 1e-9))
        shared = np.maximum(((rest.T @ rest / len(rest) / np.outer(spread, spread)) ** 2).sum(axis=0), 1.0)
        fired, silent = np.log(rates[0] / rates[1]) / shared, np.log((1 - rates[0]) / (1 - rates[1])) / shared
        posterior = sigmoid(np.log(prior / (1 - prior)) + said + fires @ (fired - silent) + silent.sum())
    return posterior, {"rates": rates, "shared": shared}


def _collect_counts(counter: Counter):
    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=SLICE_ROWS):
            votes, hashed, length = counter(batch.column("text").to_pylist())
            packed = np.minimum(np.concatenate([votes, hashed], axis=1), 65535).astype(np.uint16)
            arrays = [batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(length, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "label", "counts", "length"])

    return counts


@dataclass
class Classifier:
    counter: Counter
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        counted = self.counter(texts)
        return sigmoid(self.slope * logits(self.counter.inputs(*counted), self.weights) + self.offset)


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, sample_rows: int = SAMPLE, fit_rows: int = FIT_ROWS) -> Classifier:
    """``docs`` has ``doc_id, text``, ``labels`` ``doc_id, toxic``; ``learn_from`` is a condition on ``doc_id``."""
    ids = labelled_ids(labels.select("doc_id", "toxic"), "toxic", sample_rows, learn_from)
    sample = materialize(with_labels(docs.select("doc_id", "text"), ids), "labelled")
    counter = Counter(find_voters(sample))
    kind = dict(sample.dtypes)["doc_id"]
    rows = sample.select("doc_id", "text", "label").mapInArrow(_collect_counts(counter), f"doc_id {kind}, label int, counts binary, length long")
    rows = rows.orderBy(F.xxhash64("doc_id"), F.xxhash64("counts")).limit(fit_rows).collect()
    truth = np.array([r["label"] for r in rows])
    if len({*truth.tolist()}) < 2:
        weights = np.zeros(counter.size + HASHED + 1)
        weights[: counter.lexicon], weights[-1] = 4.0, -2.0
        return Classifier(counter, weights, 1.0, 0.0)
    packed = np.stack([np.frombuffer(r["counts"], np.uint16) for r in rows]).astype(np.float64)
    votes, hashed, length = packed[:, : counter.size], packed[:, counter.size :], np.array([r["length"] for r in rows])
    posterior, _ = label_model(counter.firing(votes, length), truth)
    inputs = counter.inputs(votes, hashed, length)
    weights = fit_logistic(inputs, posterior)
    return Classifier(counter, weights, *calibration(logits(inputs, weights), truth))


def _score(classifier: Classifier):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=SLICE_ROWS):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(classifier.score(batch.column("text").to_pylist()))], names=["doc_id", "score"])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row; the score is the chance of the label 1."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    classifier = fit(rows, labels, learn_from)
    scored = rows.mapInArrow(_score(classifier), f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def without_toxic(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose score stays below one half; rows pass in slices, as Arrow holds them."""

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, rows=SLICE_ROWS):
            yield batch.filter(pa.array(classifier.score(batch.column(text).to_pylist()) < 0.5))

    return docs.mapInArrow(kept, docs.schema)
