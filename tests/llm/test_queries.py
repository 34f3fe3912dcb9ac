"""The registered queries against their SQL, held-out accuracy, and the pipeline against its stages' operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hourgrid.llm.queries import QUERIES
from hourgrid.llm.staging import table
from tests.test_oracle import as_sorted

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = QUERIES[name].run(spark, SF_DIR)
    cursor = connection.execute(QUERIES[name].sql)
    assert as_sorted(df.collect(), df.columns) == as_sorted(cursor.fetchall(), [c[0] for c in cursor.description])


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF_DIR.replace("0.001", "0.01"), "documents"), table(spark, SF_DIR.replace("0.001", "0.01"), "labels")
    languages = QUERIES["op3_language_id"].run(spark, SF_DIR.replace("0.001", "0.01")).where("held_out").join(docs, "doc_id")
    assert languages.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95
    toxic = QUERIES["op6_toxicity"].run(spark, SF_DIR.replace("0.001", "0.01")).where("held_out").join(labels, "doc_id")
    assert toxic.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.95


def test_pipeline_stages_keep_rows_and_columns(spark):
    docs = table(spark, SF_DIR, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF_DIR)
        assert after.columns[: len(docs.columns)] == docs.columns
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert after.exceptAll(before).isEmpty() and after.count() > 0.7 * before.count()
        if name == "sharding":
            assert after.count() == before.count()
        before = spark.createDataFrame(after.select(*docs.columns).collect(), docs.schema)
