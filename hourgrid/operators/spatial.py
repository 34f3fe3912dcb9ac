"""Spatial left join: points to the polygons that contain them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.geometry import edges_of, within
from hourgrid.session import materialize

#: A cell is divided into so many columns and rows.
SPLIT = 4
#: Cells that more edges pass are divided again, at most ``SPLITS`` times and not below the smallest cell.
FEW_EDGES = 16
SPLITS = 5
#: Part of a cell's size by which edges are looked for beyond its border, for rounding.
MARGIN = 1e-6
CELL = ("_level", "_cell_x", "_cell_y")


def _cell(value: Column, size: Column | float) -> Column:
    return F.floor(value / size).cast("long")


def _size(level: Column, cell: float) -> Column:
    return F.pow(F.lit(float(SPLIT)), level) * F.lit(cell)


def _passes(edge: Column, left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """Whether an edge may pass a cell: it reaches the cell's box, and the corners lie on both sides of its line."""
    x1, y1, x2, y2 = (edge[c] for c in ("x1", "y1", "x2", "y2"))
    in_x = (F.least(x1, x2) <= right) & (F.greatest(x1, x2) >= left)
    in_y = (F.least(y1, y2) <= top) & (F.greatest(y1, y2) >= bottom)
    sides = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (left, right) for y in (bottom, top)]
    return in_x & in_y & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _covered(cells: DataFrame, cell: float) -> DataFrame:
    """Each cell with the edges that matter there and how many pass it; cells outside the polygon are left out.

    A ray to the right from a point in a cell meets no edge above, below or to the left of the cell. A cell that no edge
    passes lies inside or outside as a whole, and one inside keeps no edges.
    """
    size = _size(F.col("_level"), cell)
    left, right = ((F.col("_cell_x") + F.lit(d)) * size for d in (-MARGIN, 1 + MARGIN))
    bottom, top = ((F.col("_cell_y") + F.lit(d)) * size for d in (-MARGIN, 1 + MARGIN))
    placed = cells.withColumns({"_left": left, "_right": right, "_bottom": bottom, "_top": top})
    reaches = lambda e: (F.greatest(e["y1"], e["y2"]) >= F.col("_bottom")) & (F.least(e["y1"], e["y2"]) <= F.col("_top"))
    passing = F.size(F.filter("_edges", lambda e: _passes(e, *map(F.col, ("_left", "_bottom", "_right", "_top")))))
    placed = placed.withColumn("_edges", F.filter("_edges", lambda e: reaches(e) & (F.greatest(e["x1"], e["x2"]) >= F.col("_left"))))
    placed = placed.withColumn("_passing", F.when(F.col("_inside"), 0).otherwise(passing))
    middle = within(F.col("_edges"), (F.col("_left") + F.col("_right")) / 2, (F.col("_bottom") + F.col("_top")) / 2)
    inside = F.col("_inside") | (F.col("_passing") == 0) & middle
    kept = placed.withColumn("_inside", inside).where("_inside OR _passing > 0")
    no_edges = F.filter("_edges", lambda e: F.lit(False))
    return kept.withColumn("_edges", F.when(F.col("_inside"), no_edges).otherwise(F.col("_edges"))).drop("_left", "_right", "_bottom", "_top")


def polygon_cells(polygons: DataFrame, geometry: str, attributes: Sequence[str], cell: float) -> DataFrame:
    """The cells that cover each polygon, with the edges that matter in each.

    Cells measure ``cell`` times a power of ``SPLIT``. A polygon starts with the few cells, as large as its extent, that
    its bounding box touches. Those that many edges pass are divided again and again; those without edges stay as large
    as they are. Their number thus follows the number of edges, whatever the polygon's extent.
    """
    with_edges = polygons.select(*attributes, edges_of(F.col(geometry)).alias("_edges")).where(F.size("_edges") > 0)

    def values(side: str) -> Column:
        return F.transform("_edges", lambda e: e[side])

    def extreme(pick, *sides: str) -> Column:
        return pick(F.concat(*map(values, sides)))

    boxed = with_edges.withColumns(
        {"_x_lo": extreme(F.array_min, "x1", "x2"), "_x_hi": extreme(F.array_max, "x1", "x2"), "_y_lo": extreme(F.array_min, "y1", "y2"), "_y_hi": extreme(F.array_max, "y1", "y2")}
    )
    extent = F.greatest(F.col("_x_hi") - F.col("_x_lo"), F.col("_y_hi") - F.col("_y_lo"))
    steps = F.ceil(F.log(F.greatest(extent / F.lit(cell), F.lit(1.0))) / F.lit(math.log(SPLIT)))
    boxed = boxed.withColumn("_level", steps.cast("int"))
    size = _size(F.col("_level"), cell)
    # one cell of margin covers rounding; cells outside the polygon are dropped
    columns, rows = (F.sequence(_cell(F.col(lo), size) - 1, _cell(F.col(hi), size) + 1) for lo, hi in (("_x_lo", "_x_hi"), ("_y_lo", "_y_hi")))
    cells = boxed.withColumn("_cell_x", F.explode(columns)).withColumn("_cell_y", F.explode(rows)).withColumn("_inside", F.lit(False))
    covered = _covered(cells, cell)
    for _ in range(SPLITS):
        divide = (F.col("_passing") > FEW_EDGES) & (F.col("_level") > 0)
        parts = F.transform(
            F.sequence(F.lit(0), F.lit(SPLIT * SPLIT - 1)),
            lambda i: F.struct(
                (F.col("_level") - 1).alias("_level"), (F.col("_cell_x") * SPLIT + i % SPLIT).alias("_cell_x"), (F.col("_cell_y") * SPLIT + F.floor(i / SPLIT)).alias("_cell_y")
            ),
        )
        same = F.array(F.struct(*CELL))
        divided = covered.withColumn("_part", F.explode(F.when(divide, parts).otherwise(same))).drop(*CELL, "_passing")
        covered = _covered(divided.select("*", "_part.*").drop("_part"), cell)
    return covered.drop("_passing")


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    attributes: Sequence[str],
    lon: str = "longitude",
    lat: str = "latitude",
    geometry: str = "geometry",
    cell: float = 0.01,
) -> DataFrame:
    """Every point with the attributes of each polygon it lies within; unmatched points get nulls.

    A point has one cell of each size that the polygons use, which are few, and every such cell has one row with the
    polygons that reach it. So there is one equi-join for each size, which never multiplies points. Small polygon sets are
    broadcast by measured size; larger ones shuffle by cell, where adaptive execution splits a cell that holds most of
    the points (only the point side needs splitting, which a left outer join allows).
    """
    cells = materialize(polygon_cells(polygons, geometry, attributes, cell), "cells")
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    candidate = F.struct(*attributes, "_edges", "_inside")
    reached = points
    levels = sorted(r["_level"] for r in cells.select("_level").distinct().collect())
    for level in levels:
        size = cell * SPLIT**level
        in_cell = cells.where(F.col("_level") == level).groupBy(F.col("_cell_x").alias("_px"), F.col("_cell_y").alias("_py"))
        found = in_cell.agg(F.collect_list(candidate).alias(f"_reach_{level}"))
        located = reached.withColumns({"_px": _cell(x, size), "_py": _cell(y, size)})
        reached = located.join(found, ["_px", "_py"], "left").drop("_px", "_py")
    if not levels:
        kinds = {f.name: f.dataType for f in polygons.schema}
        return points.select("*", *[F.lit(None).cast(kinds[a]).alias(a) for a in attributes])
    every = F.flatten(F.array_compact(F.array(*[f"_reach_{level}" for level in levels])))
    around = F.filter(every, lambda p: p["_inside"] | within(p["_edges"], x, y))
    return reached.select(*points.columns, F.explode_outer(around).alias("_polygon")).select(*points.columns, *[F.col(f"_polygon.{a}").alias(a) for a in attributes])
