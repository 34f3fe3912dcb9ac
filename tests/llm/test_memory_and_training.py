"""Language profiles by definition and in bounded memory; co-training over a table."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from hourgrid.llm import decontamination, language, near_duplicates, quality, surrogates
from hourgrid.llm.queries import QUERIES
from hourgrid.llm.staging import identified
from hourgrid.session import materialize

SF_DIR = "/root/testdata/sf0.001"
SF_LARGER = "/root/testdata/sf0.01"


def plain_bundle(text, dimensions):
    """Letter by letter, as the definition says."""
    blanked = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    said = " " + " ".join(blanked.split()) + " " if blanked.strip() else " "
    vector = {c: language._letter_vectors(np.array([0 if c == " " else ord(c)]), dimensions)[0].astype(np.int64) for c in set(said)}
    total = np.zeros(dimensions, np.int64)
    for a, b, c in zip(said, said[1:], said[2:], strict=False):
        if b != " ":
            total += vector[c] * np.roll(vector[b], 1) * np.roll(vector[a], 2)
    return total


def test_bundles_equal_the_definition_in_groups_and_pieces(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdé ßİΣ.,1\n字中文", k=rng.randint(0, 60))) for _ in range(120)] + [None, "", " 1 ", "..." * 40]
    texts += ["".join(rng.choices("xyz  ,,字", k=n)) for n in (63, 64, 65, 128, 129, 400)] + ["," * 200 + "a" + "," * 200, "b" + " " * 300 + "c"]
    want = [plain_bundle(t, 32) for t in texts]
    for piece, group in ((1 << 17, 512), (64, 3), (7, 1)):
        monkeypatch.setattr(language, "_PIECE", piece)
        monkeypatch.setattr(language, "_TEXTS", group)
        monkeypatch.setattr(language, "_BLOCK", 5)
        found, has = language.Profiles(32).bundles(texts)
        assert (found == np.stack(want)).all()
        assert has.tolist() == [any(c.isalpha() for c in (t or "").lower()) for t in texts]


def test_predictions_equal_plain_cosines(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in docs.collect()][:200]
    learn = [r for r in rows if r["doc_id"] % 2]
    sums = {}
    for r in learn:
        if r["lang"] is not None and r["text"] is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + plain_bundle(r["text"], 256)
    names = sorted(sums)
    got = {r["doc_id"]: r for r in language.predict_languages(docs, F.col("doc_id") % 2 == 1, dimensions=256).collect()}
    for r in rows:
        own = plain_bundle(r["text"], 256)
        if not own.any():
            continue
        cosines = [own @ sums[n] / np.linalg.norm(own) / np.linalg.norm(sums[n]) for n in names]
        assert got[r["doc_id"]]["lang_pred"] == names[int(np.argmax(cosines))]
        assert abs(got[r["doc_id"]]["score"] - max(max(cosines), 0)) < 1e-4


def peak_of(texts):
    profiles = language.Profiles()
    tracemalloc.start()
    for at in range(0, len(texts), 512):
        profiles.bundles(texts[at : at + 512])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_memory_is_bounded_for_long_and_for_many_texts():
    rng = np.random.default_rng(1)
    varied = "".join(map(chr, rng.integers(0x4E00, 0x9000, 700_000).tolist()))
    assert peak_of([varied]) < 400
    short = ["".join(map(chr, row)) for row in rng.integers(0x4E00, 0x5200, (20_000, 16)).tolist()]
    assert peak_of(short) < 400


def test_co_training_on_a_table_equals_that_in_memory(spark):
    rng = np.random.default_rng(3)
    n = 1500
    y = rng.integers(0, 2, n)
    content = (y[:, None] * 3 + rng.normal(size=(n, quality.CONTENT))).astype(np.float32)
    places = np.column_stack([y * 7 + rng.integers(0, 3, n), rng.integers(0, 5, n)])
    chars = [None if i % 9 == 0 else int(100 + 50 * y[i] + rng.integers(0, 9)) for i in range(n)]
    metadata = quality.metadata_measures(places, chars)
    rows = [(bytearray(content[i].tobytes()), int(places[i, 0]), int(places[i, 1]), chars[i]) for i in range(80, n)]
    table = spark.createDataFrame(rows, quality.MEASURED).repartition(5)
    known = content[:80].astype(float), metadata[:80]
    one = quality.co_train(known, y[:80].astype(float), (content[80:].astype(float), metadata[80:]))
    other = quality.co_train(known, y[:80].astype(float), quality.Table(table))
    assert one.exchanged == other.exchanged and sum(a + b for a, b in one.exchanged) > 1000
    for a, b in zip(one.views, other.views, strict=True):
        np.testing.assert_allclose(a.weights, b.weights, rtol=1e-6, atol=1e-8)


def test_quality_agrees_with_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF_LARGER}/labels.parquet")
    scored = QUERIES["op8_quality"].run(spark, SF_LARGER).where("held_out").join(labels, "doc_id")
    assert scored.agg(F.avg((F.col("keep").cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_leaks_of_several_blocks_of_items_are_those_of_one(spark, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "benchmark"))
    want = sorted(tuple(r) for r in decontamination.find_leaks(docs, benchmark).collect())
    blocks = decontamination.item_blocks
    monkeypatch.setattr(decontamination, "item_blocks", lambda items, item_id: blocks(items, item_id, block=9))
    assert sorted(tuple(r) for r in decontamination.find_leaks(docs, benchmark).collect()) == want and want


def test_plan_of_surrogates_lists_letters_once(spark):
    """Spark keeps a plan's text on the driver, and writes it anew with every finished stage."""
    listed = [("card", "4111111111111111", 0), ("email", "a.b@c-d.de", 5), ("family", "Müller", 4), ("first female", "Анна", 1), ("iban", "DE89370400440532013000", 3), ("ip", "10.2.3.4", 1), ("phone", "+4915112345678", 7)]
    parts = spark.createDataFrame(listed, "part string, norm string, attempt int")
    drawn = parts.select("part", surrogates.surrogate(F.col("norm"), F.col("part"), F.col("attempt"), "test").alias("s"))
    assert len(drawn._jdf.queryExecution().executedPlan().toString()) < 150_000
    got = {r["part"]: r["s"] for r in drawn.collect()}
    assert got == {
        "card": "4155142614808421", "email": "o.bld@s-x.de", "family": "Näzbexm", "first female": "Ольга", "iban": "DE09115387655238202460",
        "ip": "70.214.136.120", "phone": "+46844495090431948",
    }


def test_texts_of_classes_are_shuffled_and_sorted_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c d"), (None, "e f"), (3, None)], "doc_id long, text string")
    rows = materialize(identified(docs), "rows")
    chosen = materialize(rows.where("doc_id IS NULL OR doc_id < 2").distinct().select((F.col("row_id") + 7).alias("class"), "row_id", "row_hash"), "chosen")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = near_duplicates._texts(rows, chosen)
        plan = texts._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, texts.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the texts and the chosen keys once each
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 2
    assert got == [(7, "e f"), (8, "a b")]
