"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.session import materialize


def labelled_ids(labels: DataFrame, label: str, rows: int, learn_from: Column, salt: int = 0) -> DataFrame:
    """At most ``rows`` ids with their 0 or 1 in ``label``, by the order of a hash; rows without id or label are left out.

    An id with several labels gets the larger one. ``learn_from`` is a condition on ``doc_id``. The ids are written, so
    that Spark knows how few they are before it plans a join with documents, and shuffles no text for it.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn_from)
    once = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).where("label IN (0, 1)")
    return materialize(once.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(rows), "ids")


def with_labels(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of the sampled ids, which ``labelled_ids`` bounds in number, so that Spark can broadcast them."""
    return docs.join(ids, "doc_id")
