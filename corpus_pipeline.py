"""The cleaning pipeline over ``documents``: each stage applies one operator of ``hourgrid.llm`` to what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourgrid.llm import stages
from hourgrid.llm.staging import table
from hourgrid.session import materialize

STAGES = [
    ("toxicity", stages.without_toxic),
    ("near_duplicates", stages.without_near_duplicates),
    ("decontamination", stages.without_benchmark),
    ("mixing", stages.mixed),
    ("sharding", stages.sharded),
]

#: The first stage's classifier has no SQL form. Tests hold near-duplicates and leaks against brute force, and check what each stage keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's result is written as Parquet and read again by the next.

    Documents without words stay until the mix, which takes none of a source that has no words; an empty table gives an
    empty result; columns that sharding adds too get ``_before`` added to their names.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
