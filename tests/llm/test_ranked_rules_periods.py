"""Ranked search, voting rules and periodic runs against brute force, and on nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.llm import lexical, periods, rules
from hourgrid.llm.queries import QUERIES
from hourgrid.llm.words import find_words

SCHEMA = "doc_id long, text string, runs string, n_words string, item string, score string, rank string"
SF_DIR = "/root/testdata/sf0.001"


def corpus():
    rng = random.Random(3)
    say = lambda n, k=60: " ".join(rng.choices([f"w{i}" for i in range(k)], k=n))
    texts = [say(30), say(30), "w1 w2", "W1, w2!", "", None, " \n\t ", "###", say(4000, 400), "ÉTÉ été Été", "a" * 300_000, "w3 " * 500]
    texts += [say(rng.randint(5, 80)) for _ in range(60)]
    rows = [(i, t, "x", "y", "z", "s", "r") for i, t in enumerate(texts)]
    return rows + [rows[0], rows[3], (None, texts[0], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def ranked(rows, items, k):
    found = [(r[0], collections.Counter(terms(r[1]))) for r in rows if terms(r[1])]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    frequency = collections.Counter(t for _, c in found for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, count in found:
            m = 75 + 25 * sum(count.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1))) * (10**9 * count[t] // (1000 * count[t] + 12 * m)) for t in terms(text) if t in count)
            scored += [(-score, math.inf if doc_id is None else doc_id)] if score > 0 else []
        out += [(item_id, rank, None if doc_id == math.inf else doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "w1 w2 w2 w59"), (2, "W7 été"), (3, None), (4, "..."), (5, "unknown"), (None, "w3 w4"), (1, "w1 w2 w2 w59"), (6, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("settings", [{}, {"GROUP_POSTINGS": 200, "DEPTH": 2}])
def test_ranked_search_equals_brute_force(spark, docs, empty, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(lexical, name, value)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for k, block in ((20, 1 << 20), (3, 60)):
        got = sorted((tuple(r) for r in lexical.ranked_search(docs, items, k, block_bytes=block).collect()), key=str)
        assert got == ranked(corpus(), ITEMS, k)
    assert not lexical.ranked_search(empty, items).collect()
    assert not lexical.ranked_search(docs, items.limit(0)).collect()


def test_lists_are_not_read_to_their_end():
    """Two lists agree on their best documents, far above the rest."""
    n = 5_000
    impacts = np.concatenate([np.full(30, 1000), np.full(n - 30, 10)])
    lists = lexical.Lists(np.arange(n), np.tile(np.arange(n), 2), np.tile(impacts, 2), np.array([0, n, 2 * n]))
    best = lexical.Best(20)
    read = lexical.search(lists, np.array([0, 1]), np.array([1, 2]), best)
    assert best.ids.tolist() == list(range(20)) and set(best.scores.tolist()) == {3000} and read < n / 5
    # a later group whose best scores lie below is left after the first round
    lists.impacts = lists.impacts // 10
    assert lexical.search(lists, np.array([0, 1]), np.array([1, 2]), best) == 2 * lexical.DEPTH and best.scores.min() == 3000


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeated(words):
    where = collections.defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    return len({i + k for found in where.values() if len(found) > 1 for i in found for k in range(3)})


def rule_texts():
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choices(["Anna", "geht", "heute", "über", "eine", "lange", "Straße.", "dann", "weiter,", "ruhig"] + ["wort" + chr(97 + i % 20) + chr(97 + i // 20) for i in range(200)], k=n))
    texts = [say(rng.randint(60, 200)) + "." for _ in range(80)]
    texts += [" ".join(w + "***" for w in say(80).split()) for _ in range(6)] + [" ".join(w.upper() + "!!" for w in say(70).split()) for _ in range(6)]
    texts += [None, "", " \n ", "ein kurzer Text", "a a a a", "x y z x y z", "\n".join(["gleiche Zeile"] * 40), say(30_000), "𝔘𝔫𝔦 " * 60, "a b c d a b c a b c " * 9]
    return texts


def test_rule_counts_equal_brute_force(spark):
    texts = rule_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("votes", F.lit("clash"))
    got = {r["doc_id"]: r for r in rules.apply_rules(frame).collect()}
    for i, text in enumerate(texts):
        w, lines = words_of(text), [x for x in (text or "").split("\n") if words_of(x)]
        want = {
            "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": repeated(w), "base_failed": len(w) < 50 or 100 * repeated(w) > 50 * len(w), "n_letterless_words": sum(not any(c.isalpha() for c in x) for x in w),
        }
        assert {c: got[i][c] for c in want} == want, text
    assert all(got[i]["kept"] for i in range(80)) and not any(got[i]["kept"] for i in range(80, 92))


def test_estimation_equals_plain_expectation_maximisation(spark):
    rng = random.Random(2)
    votes = collections.Counter(tuple(rng.choice([1, 1, 0, -1]) for _ in rules.RULES) for _ in range(300))
    model = rules.fit(spark.createDataFrame([(list(v), n) for v, n in votes.items()], "votes array<int>, n long"), len(rules.RULES), rounds=4)
    share, good, bad = rules.FIRST_SHARE, [rules.FIRST_GOOD] * len(rules.RULES), [rules.FIRST_BAD] * len(rules.RULES)
    for _ in range(4):
        chance = {}
        for v in votes:
            yes, no = share, 1 - share
            for x, g, b in zip(v, good, bad, strict=True):
                yes, no = yes * {1: g, 0: 1, -1: 1 - g}[x], no * {1: 1 - b, 0: 1, -1: b}[x]
            chance[v] = yes / (yes + no)
        part = lambda j, values, of: sum(n * of(chance[v]) for v, n in votes.items() if v[j] in values)
        share = sum(n * chance[v] for v, n in votes.items()) / sum(votes.values())
        good = [(part(j, [1], lambda p: p) + rules.BELIEF * rules.FIRST_GOOD) / (part(j, [1, -1], lambda p: p) + rules.BELIEF) for j in range(len(good))]
        bad = [(part(j, [-1], lambda p: 1 - p) + rules.BELIEF * rules.FIRST_BAD) / (part(j, [1, -1], lambda p: 1 - p) + rules.BELIEF) for j in range(len(bad))]
    assert np.allclose([model.share, *model.good, *model.bad], [share, *good, *bad])


def test_rules_on_empty_table_and_repeats(spark, docs, empty):
    assert not rules.apply_rules(empty).collect()
    assert rules.apply_rules(docs).count() == docs.count()


def test_rules_agree_with_labels_and_use_no_python(spark):
    sf_dir = SF_DIR.replace("0.001", "0.01")
    kept = QUERIES["op12_quality_rules"].run(spark, sf_dir)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = kept.where("NOT base_failed").drop("quality").join(labels, "doc_id")
    right = judged.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.95


def all_runs(w, least=24, exponent=3):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            own = w[i : j + q]
            if len(own) >= max(least, exponent * q) and all(any(x != y for x, y in zip(own, own[d:], strict=False)) for d in range(1, q)):
                out.add((i, len(own), q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts(seed, count):
    rng = random.Random(seed)
    texts = []
    for _ in range(count):
        k = rng.choice([1, 2, 2, 3, 5, 40])
        w = [f"w{rng.randrange(k)}" for _ in range(rng.choice([0, 3, 30, 90, 150]))]
        for _ in range(rng.randint(0, 3)):
            q, at, times = rng.randint(1, 12), rng.randint(0, len(w)), rng.randint(2, 9)
            unit = [f"w{rng.randrange(k)}" for _ in range(q)]
            w[at:at] = (unit * times)[: q * times - rng.randrange(q)]
        texts.append(w)
    return texts


@pytest.mark.parametrize("least, exponent", [(24, 3), (6, 2), (9, 4)])
def test_runs_equal_brute_force(least, exponent):
    for seed in range(60):
        texts = periodic_texts(seed, 6)
        words = find_words([" ".join(w).encode() for w in texts])
        got = list(zip(*(c.tolist() for c in periods.runs_of(words.hashes(), words.first, least, exponent)), strict=True))
        assert got == [(i, *r) for i, w in enumerate(texts) for r in all_runs(w, least, exponent)]


def test_runs_of_long_and_structured_texts():
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 3000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    thue_morse = [bin(i).count("1") % 2 for i in range(8192)]
    cases = ["a" * 200_000, thue_morse, fibonacci[-1][:3000], "ab" * 5_000 + "c" + "ab" * 5_000]
    words = find_words([" ".join(f"w{c}" for c in case).encode() for case in cases])
    got = list(zip(*(c.tolist() for c in periods.runs_of(words.hashes(), words.first)), strict=True))
    # a Thue-Morse sequence has no cubes
    assert [r for r in got if r[0] < 2] == [(0, 0, 200_000, 1)]
    assert [r[1:] for r in got if r[0] == 2] == all_runs(list(cases[2]))
    assert [r[1:] for r in got if r[0] == 3] == [(0, 10_000, 2), (10_001, 10_000, 2)]


def by_definition(doc_id, text):
    w = words_of(text)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = all_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    runs_text = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, digest(runs_text), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs_query_equals_definition(spark, tmp_path):
    folded = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [" ".join(w) for w in periodic_texts(11, 60)]
    rng = random.Random(1)
    rows = [(10_000 + i, t) for i, t in enumerate(texts)] + [(i, " ".join(f"v{rng.randrange(500)}" for _ in range(rng.randint(0, 200)))) for i in folded[:40]]
    rows += [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 40), (folded[50], None), (folded[51], "one"), (4, "x\x0by\tz\n" * 30)]
    rows += [rows[0], rows[70]]
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fold string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"].run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((by_definition(*r) for r in rows), key=str)


def test_periodic_runs_of_documents(spark, empty):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    short = docs.where(F.size(F.split("text", " ")) < 400)
    found = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periods.periodic_runs(short).collect()}
    assert found == {r["doc_id"]: all_runs(words_of(r["text"])) for r in short.collect()}
    assert not periods.periodic_runs(empty).collect()
