"""Quality rules that vote, weighed by expectation maximisation, in DataFrame operations only.

1. Measures of each whole text: counts of words, symbols, repeated lines and words in repeated three-word windows, and
   shares of letters, capitals, sentence marks and distinct words.
2. Rules. Each looks at one measure and votes that a document is good (1), that it is bad (-1), or abstains (0), where
   the measure lies between its bounds or says nothing about the text.
3. Label model. Documents are counted by their pattern of votes, of which there are at most 3 ** rules, whatever the
   number of documents. Expectation maximisation on that table estimates, from all documents and without labels, the
   share of good documents and how often each rule that votes is right on good and on bad ones.
4. The posterior probability that a document is good replaces the demand that all rules pass. A document is kept if it
   reaches ``KEEP`` and the document passes the base rules.

Repeated windows are found inside the row by sorting the text's window hashes, only where some hash occurs twice; no
text is exploded or shuffled, and one row is one text, however long.

A null or blank text has no words, counts of 0, and fails the base rules; repeated rows count as often as they occur;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.session import materialize

SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
LETTERLESS = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"
SYMBOLS = "#*$%&|<>"
MARKS = ".!?"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
KEEP = 0.5
ROUNDS = 25
#: Before the data, every rule is right on nearly all good documents and on a quarter of the bad ones, as each sees one kind of fault.
FIRST_GOOD, FIRST_BAD = 0.97, 0.25
#: So many documents' worth of that belief stay; it keeps a rule that hardly ever votes near it.
BELIEF = 20.0
FIRST_SHARE = 0.8


@dataclass(frozen=True)
class Rule:
    """Bounds of a measure: good within ``good``, bad outside ``fair``, both with their ends, else an abstention."""

    measure: str
    good: tuple[float, float]
    fair: tuple[float, float]


NONE = float("-inf")
ANY = float("inf")
RULES = (
    Rule("mean_word_chars", (3.0, 10.0), (2.0, 14.0)),
    Rule("symbols_per_word", (NONE, 0.02), (NONE, 0.1)),
    Rule("repeated_line_share", (NONE, 0.05), (NONE, 0.3)),
    Rule("repeated_word_share", (NONE, 0.1), (NONE, 0.3)),
    Rule("letter_share", (0.85, ANY), (0.7, ANY)),
    Rule("capital_share", (NONE, 0.15), (NONE, 0.4)),
    Rule("marks_per_word", (0.01, 0.25), (NONE, 0.5)),
    Rule("distinct_word_share", (0.3, ANY), (0.1, ANY)),
    Rule("letterless_word_share", (NONE, 0.05), (NONE, 0.2)),
)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_PATTERN, -1))


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def _covered(windows: Column) -> Column:
    """How many words the windows cover whose hash occurs twice; ``windows`` are the hashes by position."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def shared(s: Column) -> Column:
        same = lambda j: F.coalesce(F.get(s, j)["h"], F.lit(None))
        return F.transform(F.filter(s, lambda x, j: x["h"].eqNullSafe(same(j - 1)) | x["h"].eqNullSafe(same(j + 1))), lambda x: x["i"])

    places = F.sort_array(_with(placed, shared))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    add = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, start, add, lambda a: a["n"])


def _repeated_words(words: Column) -> Column:
    at = lambda i, k: F.get(words, i + k)
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    found = _with(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def counts(text: Column) -> Column:
    """Counts of a whole text, as a struct of longs."""
    text = F.coalesce(text, F.lit(""))
    bare = _without(text, SPACES)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    of_words = _with(
        _words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words")
        ),
    )
    of_lines = _with(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    number = lambda c: F.length(c).cast("long")
    return F.struct(
        of_words.alias("words"),
        of_lines.alias("lines"),
        number(bare).alias("word_chars"),
        (number(text) - number(_without(text, SYMBOLS))).alias("n_symbols"),
        (number(text) - number(_without(text, MARKS))).alias("n_marks"),
        F.regexp_count(text, F.lit(LETTERLESS)).cast("long").alias("n_letterless_words"),
        number(F.regexp_replace(text, r"\P{L}+", "")).alias("n_letters"),
        number(F.regexp_replace(text, r"\P{Lu}+", "")).alias("n_capitals"),
    )


def measures() -> dict[str, Column]:
    """Measures from the counts' columns; null where there is nothing to measure."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        # one line says nothing about repeated lines
        "repeated_line_share": F.when(F.col("n_lines") > 1, F.col("n_dup_lines") / F.col("n_lines")),
        "repeated_word_share": F.when(F.col("n_words") >= WINDOW, F.col("n_repeat_words") / F.col("n_words")),
        "letter_share": ratio("n_letters", "word_chars"),
        "capital_share": ratio("n_capitals", "n_letters"),
        "marks_per_word": F.when(F.col("n_words") >= LEAST_WORDS, F.col("n_marks") / F.col("n_words")),
        # long texts repeat words; every text has at most as many distinct ones as its language
        "distinct_word_share": F.when(F.col("n_words").between(LEAST_WORDS, 2_000), F.col("n_distinct_words") / F.col("n_words")),
        "letterless_word_share": ratio("n_letterless_words", "n_words"),
    }


def vote(rule: Rule) -> Column:
    m = F.col(rule.measure)
    within = lambda bounds: m.between(*bounds)
    return F.when(within(rule.good), 1).when(~within(rule.fair), -1).otherwise(0).cast("int")


@dataclass(frozen=True)
class Model:
    """The share of good documents, and each rule's chance of being right on good and on bad ones, if it votes."""

    share: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, votes: Column) -> Column:
        """The chance that a document with this array of votes is good."""
        said = []
        for g, b in zip(self.good, self.bad, strict=True):
            said += [math.log((1 - g) / b), 0.0, math.log(g / (1 - b))]
        table = F.lit(said)
        start = F.lit(math.log(self.share / (1 - self.share)))
        odds = F.aggregate(F.transform(votes, lambda v, j: F.get(table, 3 * j + v + 1)), start, lambda a, x: a + x)
        return 1 / (1 + F.exp(-odds))


def _bounded(share: float) -> float:
    return min(max(share, 1e-6), 1 - 1e-6)


def fit(patterns: DataFrame, rules: int, rounds: int = ROUNDS) -> Model:
    """Expectation maximisation on ``votes, n``: documents ``n`` by their votes. Each round sums that table by rule and vote."""
    model = Model(FIRST_SHARE, (FIRST_GOOD,) * rules, (FIRST_BAD,) * rules)
    for _ in range(rounds):
        weighed = patterns.select("n", model.posterior(F.col("votes")).alias("p"), F.posexplode("votes").alias("rule", "vote"))
        rows = weighed.groupBy("rule", "vote").agg(F.sum(F.col("n") * F.col("p")).alias("good"), F.sum(F.col("n") * (1 - F.col("p"))).alias("bad")).collect()
        if not rows:
            return model
        of = {(r["rule"], r["vote"]): (r["good"], r["bad"]) for r in rows}
        take = lambda j, vote, side: of.get((j, vote), (0.0, 0.0))[side]
        right = lambda j, vote, side, first: _bounded((take(j, vote, side) + BELIEF * first) / (take(j, 1, side) + take(j, -1, side) + BELIEF))
        good, bad = (sum(take(0, v, side) for v in (-1, 0, 1)) for side in (0, 1))
        model = Model(
            _bounded(good / (good + bad)),
            tuple(right(j, 1, 0, FIRST_GOOD) for j in range(rules)),
            tuple(right(j, -1, 1, FIRST_BAD) for j in range(rules)),
        )
    return model


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the counts of each row's text, and ``votes``, one of each rule."""
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), counts(docs[f"`{text}`"]).alias("c"))
    flat = rows.select("doc_id", "c.words.*", "c.lines.*", "c.word_chars", "c.n_symbols", "c.n_marks", "c.n_letterless_words", "c.n_letters", "c.n_capitals")
    return flat.withColumns(measures()).withColumn("votes", F.array(*[vote(rule) for rule in RULES])).drop(*measures())


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Every row's id, counts, votes, ``base_failed``, ``quality`` (the posterior) and ``kept``."""
    rows = materialize(measured(docs, doc_id, text), "measured")
    patterns = materialize(rows.groupBy("votes").agg(F.count("*").alias("n")), "patterns")
    model = fit(patterns, len(RULES), rounds)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    judged = rows.withColumns({"base_failed": failed, "quality": model.posterior(F.col("votes"))})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))
