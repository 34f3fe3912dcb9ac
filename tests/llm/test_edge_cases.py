"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import collections
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.llm import decontamination, language, mixing, near_duplicates, quality, sharding, substrings, surrogates, topk, toxicity
from hourgrid.llm.components import components
from hourgrid.llm.words import _BLOCK, find_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, size string, class string"
WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=1):
    """Rows with every awkward case; columns ``row``, ``size`` and ``class`` clash with names the operators use."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    base, shared = text(120), text(60)
    near = base.split()
    near[50] = "changed"
    texts = [base, base, " ".join(near), shared + "\n" + text(40), text(30) + "\t" + shared, text(80), text(5), "one", "", " \n\t ", None, None, text(20_000)]
    texts += [text(50) for _ in range(8)]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[5], (None, text(25), None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_long_words_and_prefixes_hash_by_content():
    long = b"x" * (3 * _BLOCK + 7)
    found = find_words([b"ab " + long, long + b" abc", b"", b"ab"]).hashes()
    assert len(found) == 5 and found[1] == found[2] and found[0] == found[4] and len({*found.tolist()}) == 3
    assert find_words([b"ABC"], lower=True).hashes()[0] == find_words([b"abc"]).hashes()[0]


def test_substrings_equal_brute_force(docs, rows, empty):
    where = collections.defaultdict(list)
    for r, row in enumerate(rows):
        w = words_of(row[1])
        for i in range(len(w) - 34):
            where[tuple(w[i : i + 35])].append((r, i))
    gone = {(r, p) for found in where.values() if len(found) > 1 for r, i in found for p in range(i, i + 35)}
    want = []
    for r, row in enumerate(rows):
        w = words_of(row[1])
        kept = " ".join(x for p, x in enumerate(w) if (r, p) not in gone)
        want.append((row[0], len(w), sum((r, p) in gone for p in range(len(w))), kept, hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not substrings.remove_repeats(empty).collect()


def shingles(text, n):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words_of(text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def linked(rows, n, percent):
    sets = [shingles(r[1], n) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return sets, label


def test_near_duplicates_equal_brute_force(spark, docs, rows, empty):
    sets, label = linked(rows, 3, 85)
    smallest = {x: min((r[0] for r, y in zip(rows, label, strict=True) if y == x and r[0] is not None), default=None) for x in label}
    want = [(r[0], len(s), smallest[x], r[0] == smallest[x]) for r, s, x in zip(rows, sets, label, strict=True)]
    got = [tuple(r) for r in near_duplicates.near_duplicates(docs, shingle=3, similarity=0.85).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not near_duplicates.near_duplicates(empty).collect()
    stay = near_duplicates.one_of_each(docs)
    assert stay.columns == docs.columns
    worded = [r for r in stay.collect() if words_of(r["text"])]
    assert len(worded) == len({x for x, r in zip(linked(rows, 5, 80)[1], rows, strict=True) if words_of(r[1])})
    assert stay.count() - len(worded) == sum(not words_of(r[1]) for r in rows)


@pytest.mark.parametrize("blocks", [1, 3, 8])
def test_large_nodes_are_split_around_their_center(spark, monkeypatch, blocks):
    """A group of near copies far above the size of a node, and one whose members are all just too different."""
    monkeypatch.setattr(near_duplicates, "SMALL", 6)
    monkeypatch.setattr(near_duplicates, "BLOCKS", blocks)
    rng = random.Random(4)
    base, other = [rng.choice(WORDS) + str(i) for i in range(200)], [f"o{i}" for i in range(120)]

    def edited(words, n):
        words = list(words)
        for p in rng.sample(range(len(words)), n):
            words[p] = f"e{rng.random()}"
        return " ".join(words)

    rows = [(i, edited(base, 3)) for i in range(40)] + [(100 + i, edited(other, 5)) for i in range(30)] + [(200, " ".join(base))]
    meeting = near_duplicates.meeting_classes
    monkeypatch.setattr(near_duplicates, "meeting_classes", lambda *a, **k: meeting(*a, **k, small=6))
    _, label = linked(rows, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, similarity=0.85).collect()}
    assert got == {r[0]: rows[x][0] for r, x in zip(rows, label, strict=True)}


@pytest.mark.parametrize("blocks", [1, 8])
def test_pairs_hidden_among_templates_are_found(spark, monkeypatch, blocks):
    """Texts of one template, 0.7 similar to each other, whose nodes stay large for many levels, and pairs just above the threshold among them."""
    monkeypatch.setattr(near_duplicates, "BLOCKS", blocks)
    rng = np.random.default_rng(7)
    template, pairs = [f"t{i}" for i in range(82)], 400
    own = lambda i, n: [f"o{i}x{k}" for k in range(n)]
    rows = [(i, " ".join(rng.permutation(template + own(f"p{i // 2}", 7) + own(i, 11)))) for i in range(2 * pairs)]
    rows += [(i, " ".join(rng.permutation(template + own(i, 18)))) for i in range(2 * pairs, 1200)]
    words = {w: k for k, w in enumerate({w for r in rows for w in r[1].split()})}
    has = np.zeros((len(rows), len(words)), np.float32)
    for i, r in enumerate(rows):
        has[i, [words[w] for w in r[1].split()]] = 1
    both = has @ has.T
    similar = both / (200 - both) >= 0.8
    assert similar.sum() == len(rows) + 2 * pairs
    want = {i: int(np.flatnonzero(similar[i])[0]) for i in range(len(rows))}
    meeting = near_duplicates.meeting_classes
    monkeypatch.setattr(near_duplicates, "meeting_classes", lambda *a, **k: meeting(*a, **k, small=100))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=1, similarity=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_the_trees_keep_the_chance_of_a_miss_at_every_depth():
    for similarity in (0.8, 0.85):
        trees = [near_duplicates.trees_needed(similarity, d) for d in range(near_duplicates.STEP, near_duplicates.DEPTH + 1, near_duplicates.STEP)]
        assert trees[0] <= near_duplicates.TREES < trees[1] and trees == sorted(trees)
        assert near_duplicates.miss_chance(similarity, near_duplicates.DEPTH, trees[-1]) <= 1e-5 < near_duplicates.miss_chance(similarity, near_duplicates.DEPTH, near_duplicates.TREES)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(5, 5), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


def test_decontamination_equals_brute_force(spark, docs, rows, empty):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices(WORDS, k=n))) for i, n in enumerate((12, 20, 20, 45))] + [(4, "too short"), (5, None), (6, rows[6][1])]
    changed = items[3][1].split()
    changed[2] = "other"
    texts = [(1, rows[5][1] + " " + items[0][1].upper() + ". " + rows[6][1]), (2, " ".join(changed)), (3, " ".join(items[1][1].split()[:10])), (4, None), (5, ""), (6, items[2][1]), (6, items[2][1])]
    leaked = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc, text in texts:
        w = re.findall(r"\w+", (text or "").lower())
        for item, said in items:
            own = (said or "").lower().split()
            target = collections.Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
            best = (0.0, 0)
            for at in range(len(w) - len(own) + 1) if target else ():
                window = collections.Counter(tuple(w[i : i + 5]) for i in range(at, at + len(own) - 4))
                best = max(best, (sum((target & window).values()) / sum((target | window).values()), -at))
            if best[0] >= 0.8:
                want.append((doc, item, round(best[0], 6), -best[1], len(own)))
    got = [(*r[:2], round(r[2], 6), *r[3:]) for r in decontamination.find_leaks(leaked, benchmark).collect()]
    assert sorted(got) == sorted(want) and len(want) == 5
    assert not decontamination.find_leaks(empty, benchmark).collect()
    assert not decontamination.find_leaks(docs, benchmark.limit(0)).collect()


def test_documents_shorter_than_an_item_equal_brute_force(spark):
    """Items with words cut off at either end, alone and within longer texts."""
    rng = random.Random(12)
    items = [(i, " ".join(rng.choices(WORDS, k=n))) for i, n in enumerate((60, 30, 14, 6))]
    texts = []
    for _, said in items:
        w = said.split()
        for cut in range(0, 16):
            texts += [" ".join(w[cut:]), " ".join(w[: len(w) - cut]), " ".join(w[cut // 2 : len(w) - cut // 2]), " ".join(w[cut:] + rng.choices(WORDS, k=70))]
    shingled = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want, short = [], 0
    for doc, text in enumerate(texts):
        w = text.split()
        for item, said in items:
            own = said.split()
            size, best = min(len(own), len(w)), (0.0, 0)
            for at in range(len(w) - size + 1):
                window, target = shingled(w[at : at + size]), shingled(own)
                best = max(best, (sum((target & window).values()) / sum((target | window).values()), -at))
            if best[0] >= 0.8:
                want.append((doc, item, round(best[0], 6), -best[1], size))
                short += size < len(own)
    found = decontamination.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((*r[:2], round(r[2], 6), *r[3:]) for r in found.collect()) == sorted(want) and short > 40
    blocks = [*decontamination.item_blocks(spark.createDataFrame(items, "item_id long, text string"))]
    clean = decontamination.without_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), blocks[0])
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {x[0] for x in want}


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(5)
    items = decontamination.Items([0, 1], [" ".join(WORDS[:30]), " ".join(WORDS[30:70])])
    bits = np.unpackbits(items.prints.view(np.uint8), axis=1)
    for _ in range(300):
        near = bits[:1].copy()
        near[0, rng.choice(128, decontamination.RADIUS, replace=False)] ^= 1
        assert 0 in items.nearby(np.packbits(near, axis=1).view(np.uint16))[1]


def test_language(spark, docs, empty):
    texts = [(i, t, lang) for i, (t, lang) in enumerate([("the quick brown fox jumps over the lazy dog", "en"), ("der schnelle braune fuchs springt über den faulen hund", "de"), ("быстрая коричневая лиса прыгает", "ru")])]
    known = spark.createDataFrame(texts + [(9, "the dog and the fox", None), (10, "der hund über", None), (11, "лиса прыгает", None), (12, "12 ! 3", None), (13, None, "en"), (14, "", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict_languages(known, F.lit(True)).collect()}
    assert [got[i][0] for i in (9, 10, 11, 12, 13, 14)] == ["en", "de", "ru", "und", "und", "und"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[12][1] == 0
    assert language.predict_languages(docs, F.lit(True)).count() == docs.count()
    assert not language.predict_languages(empty, F.lit(True)).collect()
    assert {r["lang_pred"] for r in language.predict_languages(docs, F.lit(False)).collect()} == {"und"}


def test_a_profile_is_the_sum_of_bound_letters():
    profiles = language.Profiles(64)
    vector = {c: language._letter_vectors(np.array([0 if c == " " else ord(c)]), 64)[0].astype(int) for c in " abé"}
    want = sum(vector[x[2]] * np.roll(vector[x[1]], 1) * np.roll(vector[x[0]], 2) for x in (" ab", "abé", "bé ", " a "))
    found, has = profiles.bundles(["abÉ ... a", "", "7"])
    assert (found[0] == want).all() and has.tolist() == [True, False, False] and not found[1:].any()


def test_mix(spark, docs, rows, empty):
    got = mixing.mix(docs).select("row.doc_id", "row.source", F.col("row.size").alias("own"), "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows) and {r["own"] for r in got} == {"y", None}
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2 and r["target"] <= 2 * r["source_size"] + 1e-9
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    largest = max(len(words_of(r[1])) for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest for s in target)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert not mixing.mix(empty).collect()


def test_shards(spark, docs, rows, empty):
    got = sharding.shard(docs.drop("size"), shards=5).collect()
    assert len(got) == len(rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    clashing = sharding.shard(docs.withColumns({"size_before": F.lit(1), "slot": F.lit(2)}), shards=5)
    assert clashing.columns == [*("size_before_before" if c == "size" else c for c in docs.columns), "size_before", "slot_before", *sharding.ADDED]
    assert clashing.where("size_before_before = 'y' AND size_before = 1 AND slot_before = 2").count() == docs.where("size = 'y'").count() > 0
    assert not sharding.shard(empty.drop("size")).collect()


def test_shards_are_near_equal_under_a_hot_text(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " + "x" * (i * 7919 % 300)) for i in range(6000)]
    sizes = collections.Counter()
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 2 * 330


def test_top_k_equals_brute_force(spark):
    rng = random.Random(3)
    vectors = [(i, [float(rng.randint(-3, 3)) / 16 for _ in range(4)]) for i in range(300)]
    vectors += [(50, vectors[50][1]), (1000, [1.0, 2.0]), (1001, [3.0, 1.0]), (1050, [1.0, 1.0]), (None, [9.0] * 4), (2000, [float("nan")] * 4), (2050, None), (2100, []), (2150, [None, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.whole_components(F.col("embedding")).alias("vector"))
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, (i, v) in enumerate(whole):
        if i is not None and i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0) for c, (j, w) in enumerate(whole) if c != q and len(w) == len(v))
            want += [(i, k + 1, None if f[1] else f[2], -f[0]) for k, f in enumerate(found[:5])]
    got = [tuple(r) for r in topk.top_k(rows, rows.where("vec_id % 50 = 0"), query_block=3).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not topk.top_k(rows.limit(0), rows.limit(0)).collect()


def test_blocks_below_the_kth_score_are_skipped():
    rng = np.random.default_rng(1)
    vectors = np.repeat(rng.integers(-100, 100, (20, 8)), 256, axis=0) + rng.integers(0, 3, (5120, 8))
    best = topk.BestRows(20, 6)
    scored = topk.search_blocks(best, vectors[::256].copy(), np.arange(5120), vectors)
    assert scored < 20 * 40 / 2


def labelled(spark, n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = rng.choices(WORDS, k=rng.randint(20, 60))
        if toxic:
            words[rng.randrange(len(words))] = "idiot" if i % 2 else f"zorbl{rng.randrange(1000)}"
        text = " ".join(words) if i % 7 else ("x!! " * 40)
        rows.append((i, text + (" idiot" if toxic and i % 7 == 0 else ""), "en", f"s{i % 3}", len(text)))
        labels.append((i, int(i % 7 != 0), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, empty):
    texts, labels = labelled(spark)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    scored = toxicity.score_toxicity(texts, labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema)), F.col("doc_id") < 300).collect()
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in scored if r["doc_id"] >= 300) >= 98
    assert toxicity.score_toxicity(docs, labels.limit(0), F.lit(True)).count() == docs.count()
    assert not toxicity.score_toxicity(empty, labels, F.lit(True)).collect()
    kept = toxicity.without_toxic(texts.withColumn("score", F.lit("clash")), toxicity.fit(texts, labels, F.lit(True)))
    assert kept.count() == pytest.approx(320, abs=4) and kept.columns == [*texts.columns, "score"]


def test_the_label_model_counts_shared_voices_once():
    rng = np.random.default_rng(0)
    truth = (rng.random(2000) < 0.3).astype(int)
    vote = lambda hit, false: (rng.random(2000) < np.where(truth == 1, hit, false)).astype(float)
    one = vote(0.7, 0.1)
    posterior, model = toxicity.label_model(np.column_stack([one, one, one, vote(0.8, 0.05), vote(0.6, 0.02)]), truth)
    assert model["shared"][:3].min() > 2.5 and model["shared"][3:].max() < 1.3
    assert ((posterior >= 0.5) == truth).mean() > 0.9


def test_quality(spark, docs, empty):
    texts, labels = labelled(spark)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    scored = quality.score_quality(texts, labels, F.col("doc_id") < 300).collect()
    assert sum(truth[r["doc_id"]] == int(r["keep"]) for r in scored if r["doc_id"] >= 300) >= 98
    assert quality.score_quality(docs, labels.limit(0), F.lit(True)).count() == docs.count()
    assert not quality.score_quality(empty, labels, F.lit(True)).collect()


def test_views_teach_each_other():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 1200).astype(float)
    content, metadata = (y[:, None] * 4 + rng.normal(size=(1200, 3)), y[:, None] * 3 + rng.normal(size=(1200, 2)))
    model = quality.co_train((content[:60], metadata[:60]), y[:60], (content[60:900], metadata[60:900]))
    assert min(sum(e[k] for e in model.exchanged) for k in (0, 1)) > 50
    assert ((model.score(content[900:], metadata[900:]) >= 0.5) == y[900:]).mean() > 0.97


def test_surrogates(spark, docs, empty):
    texts = ["Mail ab.42@mail8.example.com, AB.42@mail8.example.com and ab.42@mail8.example.com", "card 4111111111111111 at 10.0.0.1", "Mrs. Anna Schmidt met г-н Иван Петров", "call +1 (988) 555-2485", None, "", "v1.2.3 of 12", "ab.42@mail8.example.com"]
    got = {r["doc_id"]: r for r in surrogates.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    mail = got[0]["text"].split()
    assert mail[1].rstrip(",") == mail[4] == got[7]["text"] and mail[2] != mail[4] and got[0]["n_entities"] == 3
    assert re.fullmatch(r"[a-z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", mail[4])
    digits = [int(d) for d in re.search(r"\d{16}", got[1]["text"])[0]]
    assert sum(sum(divmod(d * (2 - i % 2), 10)) for i, d in enumerate(digits)) % 10 == 0 and digits[0] == 4
    assert re.fullmatch(r"Mrs\. (\w+) [A-Z][a-z]+ met г-н (\w+) [А-Я][а-я]+", got[2]["text"])
    assert got[2]["text"].split()[1] in surrogates.NAMES["female", "latin"] and got[2]["text"].split()[5] in surrogates.NAMES["male", "cyrillic"]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}", got[3]["text"])
    assert [got[i]["text"] for i in (4, 5, 6)] == [None, "", "v1.2.3 of 12"]
    assert surrogates.replace_entities(docs).count() == docs.count() and not surrogates.replace_entities(empty).collect()


def test_colliding_surrogates_are_drawn_again(spark):
    entities = spark.createDataFrame([(f"10.0.{a}.{b}",) for a in range(3) for b in range(40)] + [(f"Mr {n}",) for n in "Abel Bob Carl Dan Egon Falk Gus Hans Ingo Jan Kai Lars".split()], "entity string")
    got = surrogates.surrogates_of(entities).collect()
    assert len({r["surrogate"] for r in got}) == len(got) == 132
    assert not {r["surrogate"] for r in got} & {r["entity"] for r in got}


def test_mentions_of_one_entity_in_several_forms_keep_their_link(spark):
    texts = ["Mr John Smith", "Mr. Smith", "Dr Smith", "Dr John Smith", "AB.42@mail8.example.com", "ab.42@mail8.example.com", "Ab.42@Mail8.example.COM",
             "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "+1 (988) 555-2485", "988-555-2485", "(988) 555-2485", "+44 7911 123456", "+447911123456",
             "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "Mrs Kim Lee", "Mr Kim Lee", "Ms Jones"]
    got = [r["text"] for r in surrogates.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0].split()[2] == got[1].split()[1] == got[2].split()[1] == got[3].split()[2] != got[19].split()[1]
    assert got[0].split()[1] == got[3].split()[1] and got[17].split()[1] != got[18].split()[1] and got[17].split()[2] == got[18].split()[2]
    assert len({x.lower() for x in got[4:7]}) == 1 and got[4][:2].isupper() and got[6].endswith(".COM") and got[5].islower()
    marks = [re.sub("[^A-Za-z0-9]", "", x) for x in got]
    assert len({*marks[7:10]}) == len({marks[10][1:], *marks[11:13]}) == len({*marks[13:15]}) == len({*marks[15:17]}) == 1
    form = lambda x: re.sub("[0-9]", "0", x)
    assert [form(x) for x in got[7:17]] == [form(x) for x in texts[7:17]] and got[10].startswith("+1 (")
    assert not {*texts} & {*got} and len({*got}) == len(texts)


def test_every_entity_gets_a_surrogate_in_its_script(spark, monkeypatch):
    """Other scripts, shapes with fewer surrogates than entities, and addresses without a letter to replace."""
    monkeypatch.setattr(surrogates, "LAST", 20)
    names = ["Dr Ωμέγα", "Mr Νίκος Παπαδόπουλος", "Prof Արամ", "Dr Øß", "г-н Їжак", "Dr Ꭰꭰ"]
    mails = [f"{a}@{b}.co" for a in "bcdfghjklm" for b in "bcdfghj"] + ["_@-.co", "%%@-.co"]
    short = [f"Mr {a}{b}" for a in "BCDFGHJKLM" for b in "aeiou"] + [f"Ms {n} Jones" for n in surrogates.NAMES["female", "latin"]] + [f"Ms {n}ix Jones" for n in surrogates.NAMES["male", "latin"]]
    got = {r["entity"]: r["surrogate"] for r in surrogates.surrogates_of(spark.createDataFrame([(e,) for e in names + mails + short], "entity string")).collect()}
    assert len(got) == len({*got.values()}) == len(names + mails + short) and not {*got} & {*got.values()}
    script = lambda c: unicodedata.name(c).split()[0]
    for name in names:
        for own, drawn in zip(name.split()[1:], got[name].split()[1:], strict=True):
            assert own != drawn and {script(c) for c in own} == {script(c) for c in drawn} and re.fullmatch(r"[^\W\d_]+", drawn) and drawn.istitle()
    assert all(re.fullmatch(surrogates.PATTERNS["email"], got[m]) and got[m].endswith(".co") for m in mails)
