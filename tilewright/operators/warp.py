"""Rasters of any grid onto reference grids: other resolutions that are no whole ratios, shifted corners, other UTM zones.

Everything is columns: a reference cell finds its place on the source's grid through longitude and latitude, is exploded to
the source cells it needs (one, four, or those its outline covers) and meets them in a join by tile and place.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.operators.raster import resolution_policy

GRID = ("tile_id", "epsg", "left", "top", "x_resolution", "y_resolution", "width", "height")
METHODS = ("nearest", "bilinear", "average")


def _utm(epsg: Column) -> Column:
    return epsg.between(32601, 32660) | epsg.between(32701, 32760)


def moved(rows: DataFrame, points: list[str], source: str, target: str) -> DataFrame:
    """``rows`` with the points ``<name>_x, <name>_y`` carried from the system in column ``source`` to that in ``target``.

    Systems are degrees (4326) and UTM zones; any other pair of unlike systems is an error. Steps are columns of their own,
    so that no step's expression is written out again in the next; equal systems leave a point as it is.
    """
    here, there = F.col(source), F.col(target)
    known = F.coalesce((_utm(here) | (here == 4326)) & (_utm(there) | (there == 4326)), F.lit(False))
    refused = F.raise_error(F.concat(F.lit("no way from system "), here.cast("string"), F.lit(" to "), there.cast("string"))).cast("double")
    far, degrees, root = geo.SCALE * geo.MERIDIAN, 180 / math.pi, 2 * math.sqrt(geo._N) / (1 + geo._N)
    middle = lambda system: system % 100 * 6 - 183
    false_north = lambda system: F.when(system < 32700, F.lit(0.0)).otherwise(F.lit(geo.SOUTH))
    c = lambda p, name: F.col(f"{p}_{name}")

    def series(p: str, first: str, second: str, factors: tuple[float, ...], sign: int) -> dict[str, Column]:
        one, two = c(p, first), c(p, second)
        out = {first: one, second: two}
        for k, f in enumerate(factors, 1):
            out[first] = out[first] + sign * f * F.sin(one * (2 * k)) * F.cosh(two * (2 * k))
            out[second] = out[second] + sign * f * F.cos(one * (2 * k)) * F.sinh(two * (2 * k))
        return out

    def latitude(p: str) -> Column:
        out = c(p, "chi")
        for k, d in enumerate(geo.DELTA, 1):
            out = out + d * F.sin(c(p, "chi") * (2 * k))
        return out

    steps: list[Callable[[str], dict[str, Column]]] = [
        lambda p: {
            "a": F.when(here != there, F.when(known, F.when(here != 4326, (c(p, "y") - false_north(here)) / far)).otherwise(refused)),
            "b": F.when((here != there) & (here != 4326), (c(p, "x") - geo.EAST) / far),
        },
        lambda p: series(p, "a", "b", geo.BETA, -1),
        lambda p: {"chi": F.asin(F.sin(c(p, "a")) / F.cosh(c(p, "b"))), "away": F.atan2(F.sinh(c(p, "b")), F.cos(c(p, "a")))},
        lambda p: {
            "lat": F.when(here == 4326, F.radians(c(p, "y"))).otherwise(latitude(p)),
            "lon": F.when(here == 4326, c(p, "x")).otherwise(middle(here) + c(p, "away") * degrees),
        },
        lambda p: {"s": F.sin(c(p, "lat")), "away": F.radians(c(p, "lon") - middle(there))},
        lambda p: {"t": F.sinh(F.atanh(c(p, "s")) - root * F.atanh(root * c(p, "s")))},
        lambda p: {"a": F.atan2(c(p, "t"), F.cos(c(p, "away"))), "b": F.atanh(F.sin(c(p, "away")) / F.sqrt(1 + c(p, "t") * c(p, "t")))},
        lambda p: series(p, "a", "b", geo.ALPHA, 1),
        lambda p: {
            "x": F.when(here == there, c(p, "x")).when(there == 4326, c(p, "lon")).otherwise(geo.EAST + far * c(p, "b")),
            "y": F.when(here == there, c(p, "y")).when(there == 4326, c(p, "lat") * degrees).otherwise(false_north(there) + far * c(p, "a")),
        },
    ]
    for step in steps:
        rows = rows.withColumns({f"{p}_{name}": value for p in points for name, value in step(p).items()})
    return rows.drop(*[f"{p}_{name}" for p in points for name in ("a", "b", "chi", "away", "lat", "lon", "s", "t")])


def _cells(targets: DataFrame, sources: DataFrame, how: Column) -> DataFrame:
    """Every cell of each reference grid beside the source's grid of its tile and, as ``s_how``, what its resampling shall be."""
    s = sources.select(F.col("tile_id").alias("_of"), how.alias("s_how"), *[F.col(c).alias(f"s_{c}") for c in GRID[1:]])
    met = targets.select(*GRID).join(s, F.col("tile_id") == F.col("_of")).drop("_of")
    numbered = met.withColumn("_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") * F.col("height") - 1)))
    return numbered.withColumns({"row": F.floor(F.col("_n") / F.col("width")).cast("int"), "col": (F.col("_n") % F.col("width")).cast("int")})


def _on_source(cells: DataFrame, offsets: dict[str, tuple[float, float]]) -> DataFrame:
    """``cells`` with ``<name>_v, <name>_u``: rows and columns of the source at which places of each cell lie, from its corner."""
    here = {}
    for name, (down, across) in offsets.items():
        here[f"{name}_x"] = F.col("left") + (F.col("col") + across) * F.col("x_resolution")
        here[f"{name}_y"] = F.col("top") - (F.col("row") + down) * F.col("y_resolution")
    found = moved(cells.withColumns(here), list(offsets), "epsg", "s_epsg")
    on = {}
    for name in offsets:
        on[f"{name}_v"] = (F.col("s_top") - F.col(f"{name}_y")) / F.col("s_y_resolution")
        on[f"{name}_u"] = (F.col(f"{name}_x") - F.col("s_left")) / F.col("s_x_resolution")
    return found.withColumns(on)


def _part(row: Column, col: Column, weight: Column) -> Column:
    return F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), weight.alias("w"))


def _needed(cells: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """``tile_id, row, col, _parts``: the source cells of each reference cell with weights; none where it lies outside the source.

    ``cells`` tell in ``s_how`` which of ``methods`` each of them takes.
    """
    corners = {f"p{i}{j}": (float(i), float(j)) for i in (0, 1) for j in (0, 1)} if "average" in methods else {}
    placed = _on_source(cells, ({"p": (0.5, 0.5)} if set(methods) - {"average"} else {}) | corners)
    out = F.array().cast("array<struct<row:int,col:int,w:double>>")
    found: dict[str, Column] = {}
    if corners:
        edge = lambda f, k, high: F.greatest(F.lit(0.0), F.least(f(*[F.col(f"{p}_{k}") for p in corners]), F.col(high).cast("double")))
        placed = placed.withColumns({"v0": edge(F.least, "v", "s_height"), "v1": edge(F.greatest, "v", "s_height"), "u0": edge(F.least, "u", "s_width"), "u1": edge(F.greatest, "u", "s_width")})
        v0, v1, u0, u1 = (F.col(c) for c in ("v0", "v1", "u0", "u1"))
        steps = lambda low, high: F.sequence(F.floor(low), F.greatest(F.floor(low), F.ceil(high) - 1))
        share = lambda k, low, high: F.least(high, k + 1.0) - F.greatest(low, k.cast("double"))
        covered = F.flatten(F.transform(steps(v0, v1), lambda r: F.transform(steps(u0, u1), lambda c: _part(r, c, share(r, v0, v1) * share(c, u0, u1)))))
        found["average"] = F.when((v1 > v0) & (u1 > u0), covered).otherwise(out)
    if len(found) < len(methods):
        v, u = F.col("p_v"), F.col("p_u")
        inside = (v >= 0) & (v < F.col("s_height")) & (u >= 0) & (u < F.col("s_width"))
        r, c = F.floor(v - 0.5), F.floor(u - 0.5)
        fv, fu = v - 0.5 - r, u - 0.5 - c
        found["nearest"] = F.when(inside, F.array(_part(F.floor(v), F.floor(u), F.lit(1.0)))).otherwise(out)
        four = F.array(*[_part(r + i, c + j, (fv if i else 1 - fv) * (fu if j else 1 - fu)) for i in (0, 1) for j in (0, 1)])
        found["bilinear"] = F.when(inside, four).otherwise(out)
    parts = out
    for method in methods:
        parts = F.when(F.col("s_how") == method, found[method]).otherwise(parts)
    return placed.select("tile_id", "row", "col", parts.alias("_parts"))


def _warped(pixels: DataFrame, sources: DataFrame, targets: DataFrame, how: Column, methods: tuple[str, ...]) -> DataFrame:
    wanted = _needed(_cells(targets, sources, how), methods)
    # Outer, as a plain explode would have its test for empty lists pushed below, with all steps written out in it.
    parts = wanted.select("tile_id", "row", "col", F.explode_outer("_parts").alias("_p")).where("_p.w > 0")
    known = pixels.where("valid").select(F.col("tile_id").alias("_of"), F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").cast("double").alias("_v"))
    met = parts.join(known, (F.col("tile_id") == F.col("_of")) & (F.col("_p.row") == F.col("_r")) & (F.col("_p.col") == F.col("_c")))
    found = met.groupBy("tile_id", "row", "col").agg((F.sum(F.col("_v") * F.col("_p.w")) / F.sum("_p.w")).alias("value"))
    out = _cells(targets, sources, how).select("tile_id", "row", "col").join(found, ["tile_id", "row", "col"], "left")
    return out.select("tile_id", "row", "col", F.col("value").isNotNull().alias("valid"), F.coalesce("value", F.lit(0.0)).alias("value"))


def warped(pixels: DataFrame, sources: DataFrame, targets: DataFrame, method: str) -> DataFrame:
    """``tile_id, row, col, valid, value`` on the grid of ``targets`` from ``pixels(tile_id, row, col, valid, value)`` on that of ``sources``.

    Grids are rows of ``GRID``; ``left`` and ``top`` are the upper left corner, resolutions are positive. ``nearest`` takes
    the source cell that a middle lies in, ``bilinear`` the four around it and ``average`` all that the cell's outline (the
    box around its corners on the source's grid) covers, each by its share. Source cells that are missing or not valid
    give their weight to the others; a cell is valid if any weight is left, else its value is 0.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    return _warped(pixels, sources, targets, F.lit(method), (method,))


def warped_by_policy(pixels: DataFrame, sources: DataFrame, targets: DataFrame, target_resolution: float) -> DataFrame:
    """As ``warped``, each tile by what its resolution asks: finer ones averaged, coarser ones interpolated, others by the nearest cell."""
    return _warped(pixels, sources, targets, resolution_policy(F.col("x_resolution"), target_resolution), METHODS)


def stacked(bands: dict[str, tuple[DataFrame, DataFrame]], targets: DataFrame, target_resolution: float, fill: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Bands of any grids on one reference grid: ``tile_id, row, col, valid`` and a column for each band, divided by ``scale``.

    ``bands`` maps a name to ``(pixels, grids)``; the reference grid must have the ``target_resolution`` within a tenth of a
    metre and be projected. A cell is valid if it is in every band; a band that lacks it has ``fill``.
    """
    off = (F.abs(F.col("x_resolution") - target_resolution) > 0.1) | (F.abs(F.col("y_resolution") - target_resolution) > 0.1)
    found = F.concat(F.col("tile_id"), F.lit(" has the resolution "), F.col("x_resolution").cast("string"), F.lit(f" where about {target_resolution} is expected"))
    unprojected = F.concat(F.col("tile_id"), F.lit(" needs a projected system"))
    tile = F.when(~F.coalesce(_utm(F.col("epsg")), F.lit(False)), F.raise_error(unprojected).cast("string")).when(off, F.raise_error(found).cast("string")).otherwise(F.col("tile_id"))
    grid = targets.select(tile.alias("tile_id"), *GRID[1:])
    met: DataFrame | None = None
    for name, (pixels, grids) in bands.items():
        one = warped_by_policy(pixels, grids, grid, target_resolution)
        one = one.select("tile_id", "row", "col", F.col("valid").alias(f"_valid_{name}"), F.when(F.col("valid"), F.col("value")).otherwise(F.lit(fill)).alias(name))
        met = one if met is None else met.join(one, ["tile_id", "row", "col"], "full")
    if met is None:
        raise ValueError("no bands")
    valid = F.lit(True)
    for name in bands:
        valid = valid & F.coalesce(F.col(f"_valid_{name}"), F.lit(False))
    return met.select("tile_id", "row", "col", valid.alias("valid"), *[(F.coalesce(F.col(b), F.lit(fill)) / scale).alias(b) for b in bands])
