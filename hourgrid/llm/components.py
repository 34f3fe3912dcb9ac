"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.session import materialize


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _nodes(edges: DataFrame) -> DataFrame:
    """Each node with the smallest of itself and its neighbours, and whether it is part of a finished star.

    There, no node has two smaller neighbours, or both smaller and larger ones.
    """
    lower = F.when(F.col("b") < F.col("a"), F.col("b"))
    stars = (F.min(lower) == F.max(lower)) & ~F.max(F.col("b") > F.col("a")) | F.min(lower).isNull()
    return materialize(_neighbours(edges).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"), stars.alias("star")), "nodes")


def _round(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One large-star and one small-star step; both keep components and bring nodes closer to their smallest one."""
    large = _neighbours(edges).join(nodes.select("a", "least"), "a").where("b > a")
    large = materialize(large.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), "edges")
    down = materialize(large.groupBy("a").agg(F.min("b").alias("least")), "least")
    small = large.join(down, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    # repeated edges go in the next large-star step
    return materialize(small.unionByName(down.select("a", F.col("least").alias("b"))), "edges")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``); a component is named by its smallest node.

    ``edges`` is read several times and should be a written table. A hub with a third of all edges is only ever
    reduced to a minimum, by partial sums, and joined.
    """
    edges = edges.where("a <> b")
    nodes = _nodes(edges)
    while not nodes.where("NOT star").isEmpty():
        edges = _round(edges, nodes)
        nodes = _nodes(edges)
    return nodes.select(F.col("a").alias("node"), F.col("least").alias("component"))
