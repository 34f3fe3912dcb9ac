"""Polygon feature collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MULTI_POLYGON = "array<array<array<array<double>>>>"
POLYGON = "array<array<array<double>>>"


def read_geojson(spark: SparkSession, path: str, properties: Sequence[str], one_per_line: bool = False) -> DataFrame:
    """The listed properties and the geometry of every feature, polygons as one-part multi-polygons.

    Reads ``FeatureCollection`` documents, or, with ``one_per_line``, line-delimited collections that
    Spark can split.
    """
    fields = ", ".join(f"{p}: string" for p in properties)
    geometry = "struct<type: string, coordinates: string>"
    schema = f"features array<struct<properties: struct<{fields}>, geometry: {geometry}>>"
    documents = spark.read.schema(schema).option("multiLine", not one_per_line).json(path)
    feature = documents.select(F.explode("features").alias("f"))
    coordinates = F.col("f.geometry.coordinates")
    polygons = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(coordinates, MULTI_POLYGON)).when(
        F.col("f.geometry.type") == "Polygon", F.array(F.from_json(coordinates, POLYGON))
    )
    return feature.select(*[F.col(f"f.properties.{p}").alias(p) for p in properties], polygons.alias("geometry"))
