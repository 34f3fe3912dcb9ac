"""Point-in-polygon as a column expression.

A polygon is the array of its edges over all rings (outer rings, holes, parts of a multi-polygon). A
point is inside when a ray from it crosses an odd number of edges, and lies on the boundary when some
edge passes through it; *within* means inside and not on the boundary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges_of(multi_polygon: Column) -> Column:
    """``array<array<array<array<double>>>>`` (part, ring, vertex, lon/lat) to edge structs."""

    def ring_edges(ring: Column) -> Column:
        starts = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
        ends = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
        return F.zip_with(
            starts,
            ends,
            lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")),
        )

    return F.flatten(F.transform(F.flatten(multi_polygon), ring_edges))


def _crosses(edge: Column, x: Column, y: Column) -> Column:
    spans = (edge["y1"] > y) != (edge["y2"] > y)
    rise = F.nullif(edge["y2"] - edge["y1"], F.lit(0.0))
    at_height = edge["x1"] + (y - edge["y1"]) * (edge["x2"] - edge["x1"]) / rise
    return F.coalesce(spans & (x < at_height), F.lit(False))


def _touches(edge: Column, x: Column, y: Column) -> Column:
    cross = (edge["x2"] - edge["x1"]) * (y - edge["y1"]) - (edge["y2"] - edge["y1"]) * (x - edge["x1"])
    beside_x = x.between(F.least(edge["x1"], edge["x2"]), F.greatest(edge["x1"], edge["x2"]))
    beside_y = y.between(F.least(edge["y1"], edge["y2"]), F.greatest(edge["y1"], edge["y2"]))
    return (cross == 0) & beside_x & beside_y


def within(edges: Column, x: Column, y: Column) -> Column:
    crossings = F.size(F.filter(edges, lambda e: _crosses(e, x, y)))
    return (crossings % 2 == 1) & ~F.exists(edges, lambda e: _touches(e, x, y))
