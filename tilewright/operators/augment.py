"""Deterministic augmentation draws and paired views."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.raster import d4


def view_seed(seed: int, epoch: Column, tile: Column, view: Column) -> Column:
    """The seed of a view: the first eight bytes of a SHA-256, least first, as a decimal number without sign."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), tile.cast("string"), view.cast("string")), 256)
    turned = F.concat(*[F.substring(digest, 2 * k + 1, 2) for k in range(7, -1, -1)])
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def view_draws(tiles: DataFrame, seed: int, epoch: int, fixed_views: bool = False) -> DataFrame:
    """``tile_id, view, quarter_turns, flipped``: two views of each tile, drawn anew each epoch (epoch 0 if ``fixed_views``).

    The draw is that of the standard library's generator under the view's seed, so it is made in Arrow batches.
    """
    if epoch < 0:
        raise ValueError(f"epochs count from 0, not from {epoch}")
    at = F.lit(0 if fixed_views else epoch)
    views = tiles.select("tile_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("view"))
    seeded = views.select("tile_id", "view", view_seed(seed, at, F.col("tile_id"), F.col("view")).cast("string").alias("seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, flips = [], []
            for one in batch.column("seed").to_pylist():
                generator = random.Random(int(one))
                turns.append(generator.randrange(4))
                flips.append(bool(generator.randrange(2)))
            columns = [batch.column("tile_id"), batch.column("view"), pa.array(turns, pa.int32()), pa.array(flips, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["tile_id", "view", "quarter_turns", "flipped"])

    return seeded.mapInArrow(run, "tile_id string, view int, quarter_turns int, flipped boolean")


def paired_views(pixels: DataFrame, side: int, seed: int, epoch: int, fixed_views: bool = False) -> DataFrame:
    """Both views of each tile of ``pixels(tile_id, row, col, ...)``: every column moves in lockstep, a mask too."""
    draws = view_draws(pixels.select(F.col("tile_id").cast("string").alias("tile_id")).distinct(), seed, epoch, fixed_views)
    rest = [c for c in pixels.columns if c not in ("tile_id", "row", "col")]
    met = pixels.withColumn("tile_id", F.col("tile_id").cast("string")).join(draws, "tile_id")
    n = F.lit(side)
    where = {(t, f): d4(F.col("row"), F.col("col"), n, t, f) for t in range(4) for f in (False, True)}

    def placed(nth: int) -> Column:
        out = F.lit(None).cast("int")
        for (turns, flip), to in where.items():
            out = F.when((F.col("quarter_turns") == turns) & (F.col("flipped") == flip), to[nth]).otherwise(out)
        return out

    return met.select("tile_id", "view", "quarter_turns", "flipped", placed(0).alias("row"), placed(1).alias("col"), *rest)


def check_collated(pixels: DataFrame) -> None:
    """Raise unless all tiles have one number of pixels and all or none have a mask (``valid`` without nulls)."""
    per = pixels.groupBy("tile_id").agg(F.count("*").alias("n"), F.count("valid").alias("masked"))
    found = per.agg(F.count_distinct("n").alias("shapes"), F.count_if(F.col("masked") == F.col("n")).alias("whole"), F.count_if(F.col("masked") == 0).alias("none"), F.count("*").alias("tiles")).first()
    if not found.tiles:
        raise ValueError("there is nothing to collate")
    if found.shapes > 1 or (found.whole != found.tiles and found.none != found.tiles):
        raise ValueError("tiles differ in shape, or some have a mask and others not")
