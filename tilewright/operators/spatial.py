"""Boxes against polygons of several parts and holes, by cells of a quad-tree and an exact test.

A polygon is a list of rings; a point is inside if it lies within an odd number of them, so holes, parts and rings that
cross themselves need no roles. Boxes and polygons are covered by cells of the same tree; a cell that very many boxes share
is cut in four, for both sides, until it is not. Pairs come from an equal join on cells and are then tested exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.scratch import materialize

WORLD = (-180.0, -90.0, 360.0, 180.0)  # west, south, width, height
FIRST = 4  # a cell of the first level is this part of the world's half: 2 to the power of it
HOT = 65_536
DEEPEST = 20
_BOX = ("west", "south", "east", "north")


def repaired(rings: Column) -> Column:
    """Rings without null or repeated points and without their closing point; those of fewer than three points are left out.

    A crossing needs no repair here: what it encloses an even number of times is outside.
    """

    def plain(ring: Column) -> Column:
        real = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
        before = F.concat(F.slice(real, -1, 1), F.slice(real, 1, F.greatest(F.size(real) - 1, F.lit(0))))
        pairs = F.zip_with(real, before, lambda p, q: F.struct(p.alias("p"), ((p["x"] != q["x"]) | (p["y"] != q["y"])).alias("new")))
        return F.transform(F.filter(pairs, lambda z: z["new"]), lambda z: z["p"])

    filled = F.transform(F.filter(rings, lambda r: r.isNotNull() & (F.size(r) > 2)), plain)
    return F.filter(filled, lambda r: F.size(r) > 2)


def edges_of(rings: Column) -> Column:
    """All edges of all rings, as ``x0, y0, x1, y1``, each ring closed."""

    def one(ring: Column) -> Column:
        return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1)), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))

    return F.flatten(F.transform(rings, one))


def edges_meet_box(edges: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether what ``edges`` enclose, or an edge itself, shares a point with a plain box."""

    def passes(e: Column) -> Column:
        """Whether an edge crosses the ray that leaves the box's south-west corner to the east."""
        spans = (e["y0"] > south) != (e["y1"] > south)
        at = (e["x1"] - e["x0"]) * (south - e["y0"]) / F.when(spans, e["y1"] - e["y0"]) + e["x0"]
        return F.coalesce(spans & (west < at), F.lit(False))

    def touches(e: Column) -> Column:
        """Whether an edge has a point in the box, by cutting its parameter at both pairs of sides."""

        def slab(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
            still, step = start.between(low, high), F.nullif(end - start, F.lit(0.0))
            one, two = (low - start) / step, (high - start) / step
            return F.when(start == end, F.when(still, F.lit(0.0))).otherwise(F.least(one, two)), F.when(start == end, F.when(still, F.lit(1.0))).otherwise(F.greatest(one, two))

        (a0, a1), (b0, b1) = slab(e["x0"], e["x1"], west, east), slab(e["y0"], e["y1"], south, north)
        return F.coalesce(a0.isNotNull() & b0.isNotNull() & (F.greatest(a0, b0, F.lit(0.0)) <= F.least(a1, b1, F.lit(1.0))), F.lit(False))

    near = F.exists(edges, lambda e: (F.least(e["x0"], e["x1"]) <= east) & (F.greatest(e["x0"], e["x1"]) >= west) & (F.least(e["y0"], e["y1"]) <= north) & (F.greatest(e["y0"], e["y1"]) >= south) & touches(e))
    return near | (F.size(F.filter(edges, passes)) % 2 == 1)


def edges_meet_bounds(edges: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """``edges_meet_box`` for bounds that may cross the antimeridian (west beyond east): two boxes then."""
    split = edges_meet_box(edges, west, south, F.lit(180.0), north) | edges_meet_box(edges, F.lit(-180.0), south, east, north)
    return F.when(west > east, split).otherwise(edges_meet_box(edges, west, south, east, north))


def plain_boxes(rows: DataFrame, box: Column, *keys: str) -> DataFrame:
    """``keys`` and ``west, south, east, north``: boxes that cross the antimeridian as two; a null or upside-down box is none."""
    west, south, east, north = (F.get(box, k).cast("double") for k in range(4))
    piece = lambda a, b: F.struct(a.alias("west"), south.alias("south"), b.alias("east"), north.alias("north"))
    pieces = F.when(west > east, F.array(piece(west, F.lit(180.0)), piece(F.lit(-180.0), east))).otherwise(F.array(piece(west, east)))
    usable = west.isNotNull() & east.isNotNull() & (south <= north)
    return rows.where(usable).select(*keys, F.explode(pieces).alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in _BOX])


def _index(value: Column, low: float, size: float, level: int) -> Column:
    cells = 1 << level
    return F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((value - low) / (size / cells)))).cast("long")


def _covered(rows: DataFrame, level: int) -> DataFrame:
    """``rows`` with a row for each cell of ``level`` that their boxes meet, as ``level, cx, cy``."""
    x0, x1 = (_index(F.col(c), WORLD[0], WORLD[2], level) for c in ("west", "east"))
    y0, y1 = (_index(F.col(c), WORLD[1], WORLD[3], level) for c in ("south", "north"))
    across = rows.withColumn("cx", F.explode(F.sequence(x0, x1)))
    return across.withColumn("cy", F.explode(F.sequence(y0, y1))).withColumn("level", F.lit(level))


def _cell_box(level: Column) -> tuple[Column, Column, Column, Column]:
    """The sides of a cell; those at the world's rim reach beyond it, as what lies outside counts to them."""
    cells = F.pow(F.lit(2.0), level)
    wide, high = F.lit(WORLD[2]) / cells, F.lit(WORLD[3]) / cells
    west, south = F.lit(WORLD[0]) + F.col("cx") * wide, F.lit(WORLD[1]) + F.col("cy") * high
    far = F.lit(1e9)
    return (
        F.when(F.col("cx") == 0, -far).otherwise(west), F.when(F.col("cy") == 0, -far).otherwise(south),
        F.when(F.col("cx") == cells - 1, far).otherwise(west + wide), F.when(F.col("cy") == cells - 1, far).otherwise(south + high),
    )


def _quartered(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with those in a hot cell dealt to its quarters."""
    key = [F.col(c) == F.col(f"hot_{c}") for c in ("level", "cx", "cy")]
    met = rows.join(hot, key[0] & key[1] & key[2], "left")
    quarters = F.array(*[F.struct((F.col("level") + 1).alias("level"), (F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1)])
    own = F.array(F.struct("level", "cx", "cy"))
    dealt = met.withColumn("_c", F.explode(F.when(F.col("hot_level").isNotNull(), quarters).otherwise(own)))
    return dealt.select(*[c for c in rows.columns if c not in ("level", "cx", "cy")], "_c.level", "_c.cx", "_c.cy")


def _met(rows: DataFrame, exact: bool) -> DataFrame:
    """``rows``, written, but for those whose boxes (or, if ``exact``, whose edges) do not meet their cell.

    The cell's sides are columns of the written table: a test with the sides written out in it would be worked out for
    every edge.
    """
    sides = dict(zip(("_west", "_south", "_east", "_north"), _cell_box(F.col("level")), strict=True))
    kept = materialize(rows.withColumns(sides), "cells")
    west, south, east, north = (F.col(c) for c in sides)
    test = edges_meet_box(F.col("edges"), west, south, east, north) if exact else (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    return kept.where(test).drop(*sides)


def boxes_in_polygons(boxes: DataFrame, polygons: DataFrame, hot: int = HOT, first: int = FIRST) -> DataFrame:
    """``box_id, polygon_id``: every box of ``boxes(box_id, bbox)`` with the polygons of ``polygons(polygon_id, rings)`` it shares a point with.

    ``bbox`` is west, south, east, north and may cross the antimeridian; ``rings`` is an array of arrays of ``x, y``. Null
    boxes and polygons without a ring of three points meet nothing.
    """
    left = _met(_covered(plain_boxes(boxes, F.col("bbox"), "box_id"), first), False)
    shapes = materialize(polygons.select("polygon_id", edges_of(repaired(F.col("rings"))).alias("edges")), "polygon-edges").where(F.size("edges") > 0)
    least = lambda a, b: F.array_min(F.transform("edges", lambda e: F.least(e[a], e[b])))
    most = lambda a, b: F.array_max(F.transform("edges", lambda e: F.greatest(e[a], e[b])))
    reach = [least("x0", "x1").alias("west"), least("y0", "y1").alias("south"), most("x0", "x1").alias("east"), most("y0", "y1").alias("north")]
    right = _met(_covered(shapes.select("polygon_id", "edges", *reach), first).drop(*_BOX), True)
    for level in range(first, DEEPEST):
        busy = left.where(F.col("level") == level).groupBy("level", "cx", "cy").count().where(F.col("count") > hot)
        cells = materialize(busy.select(*[F.col(c).alias(f"hot_{c}") for c in ("level", "cx", "cy")]), "hot-cells")
        if cells.isEmpty():
            break
        left, right = _met(_quartered(left, cells), False), _met(_quartered(right, cells), True)
    shape = right.select("polygon_id", "edges", *[F.col(c).alias(f"of_{c}") for c in ("level", "cx", "cy")])
    met = left.join(shape, (F.col("level") == F.col("of_level")) & (F.col("cx") == F.col("of_cx")) & (F.col("cy") == F.col("of_cy")))
    found = met.where(edges_meet_box(F.col("edges"), *[F.col(c) for c in _BOX]))
    return found.select("box_id", "polygon_id").distinct()
