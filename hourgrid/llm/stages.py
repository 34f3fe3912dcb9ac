"""The operators as stages of a pipeline: each takes documents and returns the rows it keeps, with their columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm import decontamination, mixing, near_duplicates, sharding, toxicity
from hourgrid.llm.staging import bound_batches, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half; all labels of documents at hand are learned from."""
    bound_batches(spark)
    classifier = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.without_toxic(docs, classifier)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar by 0.8 or more, directly or by way of others."""
    bound_batches(spark)
    return near_duplicates.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    bound_batches(spark)
    blocks = decontamination.item_blocks(table(spark, sf_dir, "benchmark"))
    return reduce(decontamination.without_leaks, blocks, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources by weight; a document is repeated as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their place in it."""
    bound_batches(spark)
    return sharding.shard(docs)
