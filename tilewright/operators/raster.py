"""Transforms of long pixel tables: the eight symmetries of a square, stretches and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def d4(row: Column, col: Column, side: Column, quarter_turns: int, flip: bool) -> tuple[Column, Column]:
    """Where a pixel goes under counter-clockwise quarter turns and then a horizontal flip."""
    for _ in range(quarter_turns % 4):
        row, col = side - 1 - col, row
    return (row, side - 1 - col) if flip else (row, col)


def d4_views(pixels: DataFrame, side: int) -> DataFrame:
    """All eight views of ``pixels(tile_id, row, col, ...)``, with ``quarter_turns`` and ``flipped``."""
    n = F.lit(side)
    views = []
    for turns in range(4):
        for flip in (False, True):
            row, col = d4(F.col("row"), F.col("col"), n, turns, flip)
            views.append(F.struct(F.lit(turns).alias("quarter_turns"), F.lit(flip).alias("flipped"), row.alias("row"), col.alias("col")))
    rest = [c for c in pixels.columns if c not in ("row", "col")]
    return pixels.select(*rest, F.explode(F.array(*views)).alias("_view")).select(*rest, "_view.*")


def stretched_bytes(pixels: DataFrame, band: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """``pixels`` with ``stretched``: linear between two percentiles of the tile's valid pixels, 0 to 255, half to even."""
    edges = pixels.groupBy("tile_id").agg(F.percentile(F.when(F.col("valid"), F.col(band).cast("double")), F.array(F.lit(low), F.lit(high))).alias("e"))
    edges = edges.select(F.col("tile_id").alias("of"), F.col("e")[0].alias("lo"), F.col("e")[1].alias("up"))
    edges = edges.withColumn("up", F.when(F.col("up") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("up")))
    met = pixels.join(edges, F.col("tile_id") == F.col("of"))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(band) - F.col("lo")) / (F.col("up") - F.col("lo")))) * 255
    return met.withColumn("stretched", F.bround(scaled).cast("int")).drop("of", "lo", "up")


def coarsened(pixels: DataFrame, factor: int, *bands: str) -> DataFrame:
    """Average of the valid pixels of each ``factor`` by ``factor`` block; a block is valid if all its pixels are."""
    cell = [F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")]
    return pixels.groupBy("tile_id", *cell).agg(F.bool_and("valid").alias("valid"), *[F.avg(F.when(F.col("valid"), F.col(b))).alias(b) for b in bands])


def resolution_policy(resolution: Column, target: float) -> Column:
    """Which resampling a band needs: ``average`` for finer, ``bilinear`` for coarser, else ``nearest``."""
    return F.when(resolution < 0.95 * target, "average").when(resolution > 1.05 * target, "bilinear").otherwise("nearest")


def composite(pixels: DataFrame, bands: tuple[str, str, str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """``pixels`` with the three bands stretched to 0..1 by one pair of percentiles over all three, so their relation stays.

    A tile whose percentiles coincide is all zeros.
    """
    every = pixels.select("tile_id", F.explode(F.array(*[F.col(b).cast("double") for b in bands])).alias("value"))
    edges = every.groupBy("tile_id").agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("e"))
    edges = edges.select(F.col("tile_id").alias("of"), F.col("e")[0].alias("lo"), F.col("e")[1].alias("up"))
    met = pixels.join(edges, F.col("tile_id") == F.col("of"))
    span = F.col("up") - F.col("lo")
    one = lambda b: F.when(span <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(b) - F.col("lo")) / F.nullif(span, F.lit(0.0)))))
    return met.select(*[one(c).alias(c) if c in bands else F.col(c) for c in pixels.columns])


def refined(pixels: DataFrame, factor: int, *bands: str) -> DataFrame:
    """Each pixel as ``factor`` by ``factor`` finer ones by bilinear interpolation; at the rim the nearest value goes on.

    A finer pixel is valid if the coarse pixel it lies in is. ``pixels(tile_id, row, col, valid, ...)`` meets itself at
    the four neighbours of each finer pixel's centre.
    """
    extent = pixels.groupBy("tile_id").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    steps = [k for k in range(factor)]
    fine = pixels.join(extent, "tile_id").select("tile_id", "row", "col", "valid", "last_row", "last_col", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in steps])).alias("s"))
    y, x = F.col("row") + (F.col("s.i") + 0.5) / factor - 0.5, F.col("col") + (F.col("s.j") + 0.5) / factor - 0.5
    clip = lambda v, last: F.greatest(F.lit(0.0), F.least(v, last.cast("double")))
    fine = fine.select("tile_id", "valid", (F.col("row") * factor + F.col("s.i")).alias("row"), (F.col("col") * factor + F.col("s.j")).alias("col"), clip(y, F.col("last_row")).alias("y"), clip(x, F.col("last_col")).alias("x"), "last_row", "last_col")
    y0, x0 = F.floor("y").cast("int"), F.floor("x").cast("int")
    corners = F.explode(F.array(*[
        F.struct(F.least(y0 + a, F.col("last_row")).alias("r"), F.least(x0 + b, F.col("last_col")).alias("c"),
                 ((F.col("y") - y0 if a else 1 - (F.col("y") - y0)) * (F.col("x") - x0 if b else 1 - (F.col("x") - x0))).alias("w"))
        for a in (0, 1) for b in (0, 1)
    ]))
    parts = fine.select("tile_id", "valid", "row", "col", corners.alias("p"))
    coarse = pixels.select(F.col("tile_id").alias("t"), F.col("row").alias("r"), F.col("col").alias("c"), *[F.col(b).cast("double").alias(f"_{b}") for b in bands])
    met = parts.join(coarse, (F.col("tile_id") == F.col("t")) & (F.col("p.r") == F.col("r")) & (F.col("p.c") == F.col("c")))
    return met.groupBy("tile_id", "row", "col", "valid").agg(*[F.sum(F.col(f"_{b}") * F.col("p.w")).alias(b) for b in bands])


def on_grid(bands: dict[str, tuple[DataFrame, float]], target: float) -> DataFrame:
    """Bands of several resolutions on one grid: ``tile_id, row, col, valid`` and a column for each band.

    Each band is ``(pixels(tile_id, row, col, valid, value), resolution)``, whose ratio to ``target`` is a whole number
    one way or the other. Finer ones are averaged over valid pixels, coarser ones interpolated, others taken as they are.
    A cell is valid if it is in every band; values of invalid ones are 0.
    """
    met: DataFrame | None = None
    for name, (pixels, resolution) in bands.items():
        finer, coarser = target / resolution, resolution / target
        if finer > 1.05:
            placed = coarsened(pixels, round(finer), "value")
        elif coarser > 1.05:
            placed = refined(pixels, round(coarser), "value")
        else:
            placed = pixels
        one = placed.select("tile_id", "row", "col", F.col("valid").alias(f"valid_{name}"), F.col("value").cast("double").alias(name))
        met = one if met is None else met.join(one, ["tile_id", "row", "col"], "full")
    if met is None:
        raise ValueError("no bands")
    valid = F.lit(True)
    for name in bands:
        valid = valid & F.coalesce(F.col(f"valid_{name}"), F.lit(False))
    return met.select("tile_id", "row", "col", valid.alias("valid"), *[F.when(valid, F.col(b)).otherwise(0.0).alias(b) for b in bands])


def resized(pixels: DataFrame, band: str, size_in: int, size_out: int) -> DataFrame:
    """``band`` of square tiles on a grid of another size by bilinear interpolation between pixel centres, divided by 255."""
    scale = size_in / size_out
    fine = pixels.select("tile_id").distinct().select("tile_id", F.explode(F.sequence(F.lit(0), F.lit(size_out * size_out - 1))).alias("n"))
    at = lambda k: F.greatest(F.lit(0.0), F.least((k + 0.5) * scale - 0.5, F.lit(float(size_in - 1))))
    fine = fine.select("tile_id", F.floor(F.col("n") / size_out).cast("int").alias("to_row"), (F.col("n") % size_out).cast("int").alias("to_col")).withColumn("y", at(F.col("to_row"))).withColumn("x", at(F.col("to_col")))
    y0, x0 = F.floor("y").cast("int"), F.floor("x").cast("int")
    corners = F.explode(F.array(*[
        F.struct(F.least(y0 + a, F.lit(size_in - 1)).alias("row"), F.least(x0 + b, F.lit(size_in - 1)).alias("col"),
                 ((F.col("y") - y0 if a else 1 - (F.col("y") - y0)) * (F.col("x") - x0 if b else 1 - (F.col("x") - x0))).alias("w"))
        for a in (0, 1) for b in (0, 1)
    ]))
    parts = fine.select("tile_id", "to_row", "to_col", corners.alias("p")).select("tile_id", "to_row", "to_col", "p.*")
    met = parts.join(pixels.select("tile_id", "row", "col", F.col(band).cast("double").alias("v")), ["tile_id", "row", "col"])
    return met.groupBy("tile_id", F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg((F.sum(F.col("v") * F.col("w")) / 255).alias(band))
