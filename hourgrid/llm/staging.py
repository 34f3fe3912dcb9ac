"""Reading the given tables, and marking rows of documents by their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word as the contracts define it.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = "1m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, size: str = BATCH_BYTES) -> None:
    """Let tasks get rows in Arrow batches of at most ``size``, from here on in this session.

    By default a batch has up to 10,000 rows, which of long texts are hundreds of megabytes in a task and its worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and the row's key ``(row_id, row_hash)``.

    Repeated rows share a key, and so do a null and a zero id with one text: what the operators decide with this key
    depends on the text alone. The id in the key keeps a large group of equal texts spread over many tasks.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.withColumns({"row_id": F.coalesce(F.col("doc_id"), F.lit(0)), "row_hash": F.xxhash64("text")})
