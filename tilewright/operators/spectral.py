"""Spectral indices on long pixel tables, their summaries and histograms, temporal pairs and change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.scratch import materialize

# The bands of each index, (a - b) / (a + b).
INDEX_BANDS = {"ndwi": ("b03", "b08"), "mndwi": ("b03", "b11"), "ndvi": ("b08", "b04")}
EPSILON = 1e-6


def normalized_difference(a: Column, b: Column, valid: Column, epsilon: float = EPSILON) -> Column:
    """``(a - b) / (a + b)`` where valid and the sum is clear of zero, else null."""
    a, b = a.cast("double"), b.cast("double")
    fine = valid & ~F.isnan(a) & ~F.isnan(b) & (F.abs(a + b) > epsilon)
    return F.when(fine, (a - b) / (a + b))


def index_maps(pixels: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """``pixels`` with a column for each index."""
    return pixels.select("*", *[normalized_difference(F.col(a), F.col(b), F.col("valid"), epsilon).alias(n) for n, (a, b) in INDEX_BANDS.items()])


def long_maps(maps: DataFrame, *keys: str) -> DataFrame:
    """``keys, index_name, value``: one row for each pixel and index."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("index_name"), F.col(n).alias("value")) for n in INDEX_BANDS]))
    return maps.select(*keys, cells.alias("cell")).select(*keys, "cell.index_name", "cell.value")


def summaries(values: DataFrame, *keys: str) -> DataFrame:
    """Valid pixels, mean, exact median and positive fraction of ``value``; zeros where nothing is valid."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return values.groupBy(*keys).agg(
        F.count("value").alias("valid_pixels"),
        zero(F.avg("value")).alias("mean"),
        zero(F.median("value")).alias("median"),
        zero(F.avg((F.col("value") > 0).cast("double"))).alias("positive_fraction"),
    )


def index_summaries(maps: DataFrame, *keys: str) -> DataFrame:
    """``summaries`` of each index of ``maps``, ``keys, index_name, ...``: one row a key is aggregated, then unpivoted."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    each = []
    for n in INDEX_BANDS:
        positive = F.avg((F.col(n) > 0).cast("double"))
        each += [F.count(n).alias(f"{n}_n"), zero(F.avg(n)).alias(f"{n}_mean"), zero(F.median(n)).alias(f"{n}_median"), zero(positive).alias(f"{n}_positive")]
    wide = maps.groupBy(*keys).agg(*each)
    one = lambda n: F.struct(F.lit(n).alias("index_name"), F.col(f"{n}_n").alias("valid_pixels"), F.col(f"{n}_mean").alias("mean"), F.col(f"{n}_median").alias("median"), F.col(f"{n}_positive").alias("positive_fraction"))
    return wide.select(*keys, F.explode(F.array(*[one(n) for n in INDEX_BANDS])).alias("one")).select(*keys, "one.*")


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """The histogram bin of a value in ``[low, high]``: last bin closed, edges as ``low + b * width``; null outside."""
    width = (high - low) / bins
    guess = F.least(F.floor((value - low) / width), F.lit(bins - 1))
    down = value < low + guess * width
    up = (guess < bins - 1) & (value >= low + (guess + 1) * width)
    placed = F.when(down, guess - 1).when(up, guess + 1).otherwise(guess)
    return F.when((value >= low) & (value <= high), placed).cast("int")


def histograms(values: DataFrame, low: float, high: float, bins: int, *keys: str) -> DataFrame:
    """``keys, descriptor``: for each key the bins' shares of the mass in range, an array for all indices in fixed order.

    Counts by bin are summed before they meet; an index without mass is all zeros.
    """
    names = list(INDEX_BANDS)
    binned = values.select(*keys, "index_name", bin_of(F.col("value"), low, high, bins).alias("bin"))
    counts = binned.groupBy(*keys, "index_name", "bin").count()
    listed = counts.groupBy(*keys).agg(
        *[F.map_from_entries(F.collect_list(F.when((F.col("index_name") == n) & F.col("bin").isNotNull(), F.struct("bin", "count")))).alias(n) for n in names]
    )

    def dense(name: str) -> Column:
        total = F.aggregate(F.map_values(name), F.lit(0).cast("long"), lambda s, x: s + x)
        share = lambda b: F.coalesce(F.try_element_at(F.col(name), b), F.lit(0)) / F.greatest(total, F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), share)

    return listed.select(*keys, F.concat(*[dense(n) for n in names]).alias("descriptor"))


def temporal_pairs(scenes: DataFrame, most_days: int, *carried: str) -> DataFrame:
    """``before_id, after_id, sequence_id, gap_days`` of consecutive scenes ``(tile_id, sequence_id, timestamp)``.

    Adjacency comes first: scenes of one day are neighbours that make no pair. Scenes without a time or a sequence take no
    part. ``carried`` columns come along as ``before_x`` and ``after_x``, so they need no join.
    """
    order = Window.partitionBy("sequence_id").orderBy("timestamp", "tile_id")
    both = [x for c in carried for x in (F.col(c).alias(f"before_{c}"), F.lead(c).over(order).alias(f"after_{c}"))]
    nexts = scenes.where(F.col("timestamp").isNotNull() & F.col("sequence_id").isNotNull()).select(
        "sequence_id", F.col("tile_id").alias("before_id"), F.lead("tile_id").over(order).alias("after_id"),
        F.datediff(F.to_date(F.lead("timestamp").over(order)), F.to_date("timestamp")).alias("gap_days"), *both,
    )
    return nexts.where((F.col("gap_days") > 0) & (F.col("gap_days") <= most_days))


def change_maps(pairs: DataFrame, maps: DataFrame, *cell: str) -> DataFrame:
    """After minus before, cell by cell, for each index where both are present."""
    a = maps.select(F.col("tile_id").alias("before_id"), *cell, *[F.col(n).alias(f"before_{n}") for n in INDEX_BANDS])
    b = maps.select(F.col("tile_id").alias("after_id"), *cell, *[F.col(n).alias(f"after_{n}") for n in INDEX_BANDS])
    met = pairs.join(a, "before_id").join(b, ["after_id", *cell])
    return met.select("before_id", "after_id", *cell, *[(F.col(f"after_{n}") - F.col(f"before_{n}")).alias(n) for n in INDEX_BANDS])


def ranked(scored: DataFrame, k: int, descending: bool, id_col: str) -> DataFrame:
    """The first ``k`` by score (raw and signed), ties by id, with the number of candidates before the cut.

    The scores are written once, so that neither the cut nor the count computes them again.
    """
    scored = materialize(scored, "ranked")
    by = F.col("score").desc() if descending else F.col("score").asc()
    top = scored.orderBy(by, id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(by, id_col))).withColumn("candidate_count", F.lit(scored.count()))
