"""The whole pipeline on an empty table, on nulls and on columns whose names the stages use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_edge_cases import SCHEMA, corpus

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, SCHEMA).withColumns({"shard": F.lit(7), "slot": F.lit(True)}).write.parquet(str(tmp_path / "documents.parquet"))
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_pipeline_on_an_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).collect() == []


def test_pipeline_on_nulls_and_clashing_columns(spark, folder):
    rows = corpus()
    out = corpus_pipeline.run(spark, folder(rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "size_before", "class", "shard_before", "slot_before", "size", "text_crc32", "shard", "slot"]
    found = out.collect()
    texts = {r["text"] for r in found}
    assert texts <= {r[1] for r in rows} and len(texts) > 0.8 * len({r[1] for r in rows})
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
