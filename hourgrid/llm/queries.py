"""The registered queries of this folder, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm import decontamination, language, lexical, mixing, near_duplicates, periods, quality, rules, sharding, substrings, surrogates, topk, toxicity
from hourgrid.llm.staging import table


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def remainder(doc_id: str, parts: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("similarity", F.round("similarity", 6))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return result.select("doc_id", "n_words", "n_removed", "kept_sha256")


SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT r, list(DISTINCT p) AS p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM windows WHERE h IN (SELECT h FROM repeated)) GROUP BY r),
kept AS (SELECT doc_id, w, coalesce(p, []) AS p, list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(coalesce(p, []), x[2])) AS k FROM d LEFT JOIN gone USING (r))
SELECT doc_id, len(w) AS n_words, len(p) AS n_removed, sha256(array_to_string(list_transform(k, lambda x: x[1]), ' ')) AS kept_sha256 FROM kept
"""


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    predicted = language.predict_languages(table(spark, sf_dir, "documents"), ~held_out)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=0.85)


NEAR_DEDUP = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, hash(CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 2), ' ') END) AS h FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach(r, o) AS (SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.o = e.a),
c AS (SELECT reach.r AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.o GROUP BY reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id IS NOT DISTINCT FROM c.component_id AS kept FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = mixing.mix(table(spark, sf_dir, "documents"))
    return result.select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


SOURCE_MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap, sum(2.0::DOUBLE * source_size) OVER before AS capped, sum(w) OVER before AS weighed FROM s
    WINDOW before AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget, sum(w) AS all_w FROM s),
l AS (SELECT arg_min((budget - coalesce(capped, 0)) / (all_w - coalesce(weighed, 0)), cap / w) AS level FROM o, e WHERE (budget - coalesce(capped, 0)) / (all_w - coalesce(weighed, 0)) * w <= cap),
t AS (SELECT source, source_size, least(w * coalesce(level, 0), cap) AS target, CASE WHEN source_size > 0 THEN floor(least(w * coalesce(level, 0), cap) / source_size)::BIGINT ELSE 0 END AS whole FROM o, l),
g AS (SELECT source, h, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS up_to FROM d GROUP BY source, h),
x AS (SELECT t.source AS source, t.source_size, target, whole, target - whole * t.source_size AS budget FROM t),
edge AS (SELECT g.source AS source, arg_min(h, h) AS h, arg_min(g.up_to, h) AS up_to, arg_min(g.size, h) AS size FROM g JOIN x ON g.source IS NOT DISTINCT FROM x.source WHERE g.up_to > x.budget GROUP BY g.source),
cut AS (SELECT x.source AS source, x.source_size, x.target, x.whole, CASE WHEN x.budget <= 0 THEN -1 WHEN edge.h IS NULL THEN 9223372036854775807
    WHEN edge.up_to - x.budget < x.budget - (edge.up_to - edge.size) THEN edge.h ELSE edge.h - 1 END AS threshold FROM x LEFT JOIN edge ON x.source IS NOT DISTINCT FROM edge.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, size * (whole + CASE WHEN h <= threshold THEN 1 ELSE 0 END) AS taken FROM d JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def size_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = sharding.shard(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return result.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False))
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "keep")


def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents"))


def top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    vectors = rows.select("vec_id", topk.whole_components(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


TOP_K_SEARCH = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM n WHERE rank <= 5
"""

def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED_SEARCH = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
g AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f, s GROUP BY term, docs),
m AS (SELECT doc_id, r, 100 - 25 + (25 * len(w) * docs) // total AS m FROM d, s WHERE len(w) > 0),
i AS (SELECT item_id, row_number() OVER () AS i, {_TERMS} AS w FROM benchmark),
q AS (SELECT item_id, i, term, count(*) AS times FROM (SELECT item_id, i, unnest(w) AS term FROM i) GROUP BY item_id, i, term),
p AS (SELECT item_id, i, r, any_value(doc_id) AS doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM q JOIN f USING (term) JOIN g USING (term) JOIN m USING (r) GROUP BY item_id, i, r),
n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM p WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM n WHERE rank <= 20
"""


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(table(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base, F.round("quality", 6).alias("quality"))


def _votes_sql() -> str:
    number = lambda x: {"inf": "'inf'::DOUBLE", "-inf": "'-inf'::DOUBLE"}.get(str(x), str(x))
    within = lambda r, bounds: f"{r.measure} BETWEEN {number(bounds[0])} AND {number(bounds[1])}"
    votes = [f"CASE WHEN {within(r, r.good)} THEN 1 WHEN NOT ({within(r, r.fair)}) THEN -1 ELSE 0 END" for r in rules.RULES]
    return "[" + ", ".join(votes) + "]"


def _rounds_sql() -> str:
    """Expectation (``e``) and maximisation (``m``) of every round, one after the other."""
    steps = []
    for k in range(rules.ROUNDS + 1):
        steps.append(
            f"""e{k} AS MATERIALIZED (SELECT v, any_value(n) AS n, 1 / (1 + exp(-(any_value(ln(share / (1 - share))) + sum(CASE vote WHEN 1 THEN ln(good / (1 - bad)) WHEN -1 THEN ln((1 - good) / bad) ELSE 0 END)))) AS p
    FROM long JOIN m{k} USING (j) GROUP BY v)"""
        )
        right = lambda hit, of, first: f"least(greatest((coalesce(sum({of}) FILTER (vote = {hit}), 0) + {rules.BELIEF * first}) / (coalesce(sum({of}) FILTER (vote <> 0), 0) + {rules.BELIEF}), 1e-6), 1 - 1e-6)"
        steps.append(
            f"""m{k + 1} AS MATERIALIZED (SELECT j, least(greatest(sum(n * p) / sum(n), 1e-6), 1 - 1e-6) AS share, {right(1, "n * p", rules.FIRST_GOOD)} AS good, {right(-1, "n * (1 - p)", rules.FIRST_BAD)} AS bad
    FROM long JOIN (SELECT v, p FROM e{k}) USING (v) GROUP BY j)"""
        )
    return ",\n".join(steps[:-1])


QUALITY_RULES = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
windows AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1) GROUP BY r),
c AS (SELECT doc_id, r, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(translate(t, '{rules.SYMBOLS}', '')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, length(t) - length(translate(t, '{rules.MARKS}', '')) AS n_marks,
    len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS n_letterless, length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS n_letters, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_capitals
    FROM w LEFT JOIN covered USING (r)),
x AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbols_per_word, CASE WHEN n_lines > 1 THEN n_dup_lines / n_lines END AS repeated_line_share,
    CASE WHEN n_words >= 3 THEN n_repeat_words / n_words END AS repeated_word_share, n_letters / nullif(word_chars, 0) AS letter_share, n_capitals / nullif(n_letters, 0) AS capital_share,
    CASE WHEN n_words >= 50 THEN n_marks / n_words END AS marks_per_word, CASE WHEN n_words BETWEEN 50 AND 2000 THEN n_distinct / n_words END AS distinct_word_share, n_letterless / nullif(n_words, 0) AS letterless_word_share FROM c),
v AS MATERIALIZED (SELECT *, {_votes_sql()} AS v FROM x),
long AS MATERIALIZED (SELECT v, n, j, v[j] AS vote FROM (SELECT v, count(*)::DOUBLE AS n FROM v GROUP BY v), range(1, {len(rules.RULES) + 1}) t(j)),
m0 AS (SELECT j, {rules.FIRST_SHARE}::DOUBLE AS share, {rules.FIRST_GOOD}::DOUBLE AS good, {rules.FIRST_BAD}::DOUBLE AS bad FROM range(1, {len(rules.RULES) + 1}) t(j)),
{_rounds_sql()},
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v JOIN (SELECT v, p FROM e{rules.ROUNDS}) USING (v))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= {rules.KEEP} AS kept, round(p, 6) AS quality FROM judged
"""


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periods.periodic_runs(table(spark, sf_dir, "documents"), fold=F.when(hashed % 10 == 0, F.floor(hashed / 10)))
    top = periods.highest_exponent(F.col("runs"))
    rows = found.select("doc_id", "runs", "collapsed", top.alias("top"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(periods.runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_decontamination": Query(decontaminate),
    "op2_substring_dedup": Query(substring_dedup, SUBSTRING_DEDUP),
    "op3_language_id": Query(language_id),
    "op4_near_dedup": Query(near_dedup, NEAR_DEDUP),
    "op5_source_mix": Query(source_mix, SOURCE_MIX),
    "op6_toxicity": Query(toxicity_scores),
    "op7_size_shards": Query(size_shards),
    "op8_quality": Query(quality_scores),
    "op9_pii_surrogates": Query(pii_surrogates),
    "op10_top_k_search": Query(top_k_search, TOP_K_SEARCH),
    "op11_ranked_search": Query(ranked_search, RANKED_SEARCH),
    "op12_quality_rules": Query(quality_rules, QUALITY_RULES),
    "op13_periodic_runs": Query(periodic_runs),
}
