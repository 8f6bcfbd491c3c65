"""Band statistics from exact histograms, masked moments, metadata and scene audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators.quantiles import exact_quantiles
from tilewright.scratch import materialize

QUANTILES = {"p01": 0.01, "p02": 0.02, "median": 0.5, "p98": 0.98, "p99": 0.99}


def band_statistics(values: DataFrame, nodata: int | None = None) -> DataFrame:
    """Statistics by band of ``values(band, value)``, whole numbers, from counts by value.

    Quantiles are nearest ranks on ``n - 1``: the first value whose running count reaches ``round_even(p (n - 1)) + 1``.
    The histogram of a band has one row for each distinct value, so its running sum is short however many pixels it has.
    """
    counts = values.groupBy("band", "value").agg(F.count("*").alias("n"))
    band = Window.partitionBy("band")
    running = band.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(band))
    value, n = F.col("value").cast("double"), F.col("n")
    at = lambda p: F.min(F.when(F.col("upto") >= F.bround(F.lit(p) * (F.col("total") - 1)) + 1, F.col("value")))
    found = placed.groupBy("band").agg(
        F.sum("n").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        *[at(p).alias(name) for name, p in QUANTILES.items()],
        (F.sum(value * n) / F.sum("n")).alias("mean"),
        (F.sum(value * value * n) / F.sum("n")).alias("square"),
        (F.sum(F.when(F.col("value") == 0, n).otherwise(0)) / F.sum("n")).alias("zero_fraction"),
        (F.sum(F.when(F.col("value") == F.lit(nodata), n).otherwise(0)) / F.sum("n") if nodata is not None else F.lit(None).cast("double")).alias("nodata_fraction"),
    )
    return found.withColumn("sd", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("square")


def masked_moments(values: DataFrame) -> DataFrame:
    """Mean and population deviation (at least 1e-12) by band of the valid rows of ``(band, value, valid)``."""
    return values.where("valid").groupBy("band").agg(
        F.count("*").alias("pixels"), F.avg("value").alias("mean"), F.greatest(F.stddev_pop("value"), F.lit(1e-12)).alias("sd")
    )


def standardized(value: Column, mean: Column, sd: Column, valid: Column) -> Column:
    """``(value - mean) / sd`` where valid, else 0."""
    return F.when(valid, (value - mean) / sd).otherwise(F.lit(0.0))


def metadata_summary(rows: DataFrame) -> DataFrame:
    """Counts by label and split, with the totals of each label and of all (nulls), in one pass."""
    return rows.rollup("label", "split").agg(F.count("*").alias("tiles"))


def scene_measurements(maps: DataFrame, bands: list[str], indices: list[str]) -> DataFrame:
    """One row a scene: valid pixels and fraction, share of valid pixels that are zero in all bands, medians and ranges."""
    zero = F.lit(True)
    for band in bands:
        zero = zero & (F.col(band) == 0)
    out: list[Column] = [
        F.count_if("valid").alias("valid_pixels"),
        F.count("*").alias("total_pixels"),
        F.avg(F.col("valid").cast("double")).alias("valid_fraction"),
        F.avg(F.when(F.col("valid"), zero.cast("double"))).alias("all_zero_fraction"),
    ]
    for name in indices:
        far = F.col(name).isNotNull() & (F.abs(F.col(name)) > 1.00001)
        out += [
            F.count(name).alias(f"{name}_valid"), F.median(name).alias(f"{name}_median"), F.min(name).alias(f"{name}_min"),
            F.max(name).alias(f"{name}_max"), F.count_if(far).alias(f"{name}_outside"),
        ]
    return maps.groupBy("tile_id").agg(*out)


def scene_audit(scenes: DataFrame, indices: list[str]) -> DataFrame:
    """The roll-up of scene measurements in one row; the median over all scenes is found by digits, not in one task."""
    used = ["valid_fraction", "valid_pixels", "all_zero_fraction", *[f"{n}_{c}" for n in indices for c in ("valid", "min", "max", "outside")]]
    scenes = materialize(scenes.select(*used), "scene-measurements")  # what is not used, medians by scene among it, is not computed
    middle = exact_quantiles(scenes, {"valid_fraction": (0.5,)})["valid_fraction"][0]
    out: list[Column] = [
        F.count("*").alias("scenes"),
        F.min("valid_fraction").alias("valid_fraction_min"),
        F.lit(middle).cast("double").alias("valid_fraction_median"),
        F.max("valid_fraction").alias("valid_fraction_max"),
        F.count_if(F.col("valid_pixels") == 0).alias("scenes_without_valid"),
        F.count_if(F.col("all_zero_fraction") >= 0.99).alias("scenes_all_zero"),
    ]
    for name in indices:
        out += [
            F.count_if(F.col(f"{name}_valid") == 0).alias(f"{name}_scenes_without"), F.min(f"{name}_min").alias(f"{name}_min"),
            F.max(f"{name}_max").alias(f"{name}_max"), F.sum(f"{name}_outside").alias(f"{name}_outside"), F.sum(f"{name}_valid").alias(f"{name}_valid"),
        ]
    return scenes.agg(*out)


def plain_moments(values: DataFrame) -> DataFrame:
    """Mean and deviation by band of all rows of ``(band, value)``; the variance is at least 1e-12 before its root."""
    return values.groupBy("band").agg(F.count("*").alias("pixels"), F.avg("value").alias("mean"), F.sqrt(F.greatest(F.var_pop("value"), F.lit(1e-12))).alias("sd"))


def metadata_ranges(rows: DataFrame) -> DataFrame:
    """One row over ``rows(tile_id, crs, latitude, longitude, x_resolution, y_resolution, nodata)``: counts and ranges.

    ``crs_counts`` lists coordinate systems from the commonest on, then by name; a missing one counts as such.
    """
    crs = F.coalesce("crs", F.lit("missing"))
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    whole = rows.agg(
        F.count("*").alias("tile_count"), F.count_if(~located).alias("missing_coordinate_tiles"), F.count("nodata").alias("declared_nodata_tiles"),
        *[f(F.when(located, F.col(c))).alias(f"{c}_{n}") for c in ("latitude", "longitude") for n, f in (("min", F.min), ("max", F.max))],
        *[f(c).alias(f"{c}_{n}") for c in ("x_resolution", "y_resolution") for n, f in (("min", F.min), ("max", F.max))],
    )
    counts = rows.groupBy(crs.alias("crs")).agg(F.count("*").alias("n"))  # a row for each coordinate system
    listed = counts.agg(F.count("*").alias("distinct_crs_count"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "crs"))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: F.concat(x["crs"], F.lit(":"), (-x["less"]).cast("string"))), ",")
    return whole.crossJoin(F.broadcast(listed.select("distinct_crs_count", text.alias("crs_counts"))))


def dataset_summary(scenes: DataFrame, sensor: str | None = None, bands: tuple[str, ...] = ()) -> DataFrame:
    """Available and catalogued scenes of ``scenes(asset_status, timestamp)`` and the days they span, with ``sensor`` and ``bands`` where given."""
    there = F.col("asset_status") == "available"
    day = F.when(there, F.to_date("timestamp"))
    about = {**({"sensor": F.lit(sensor)} if sensor else {}), **({"bands": F.array(*[F.lit(b) for b in bands])} if bands else {})}
    return scenes.agg(
        F.count_if(there).alias("available_scenes"), F.count("*").alias("catalog_scenes"),
        F.date_format(F.min(day), "yyyy-MM-dd").alias("date_start"), F.date_format(F.max(day), "yyyy-MM-dd").alias("date_end"),
    ).withColumns(about)


def middle_valid_pixels(maps: DataFrame) -> DataFrame:
    """For a check by hand, the middle valid pixel of each tile of ``maps(tile_id, row, col, valid, ...)`` in row-major order.

    Rows are counted first; only the middle's own row of pixels is then put in order.
    """
    valid = maps.where("valid")
    lines = valid.groupBy("tile_id", "row").agg(F.count("*").alias("n"))
    tile = Window.partitionBy("tile_id")
    before = F.coalesce(F.sum("n").over(tile.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("before", before).withColumn("middle", F.floor(F.sum("n").over(tile) / 2))
    at = placed.where((F.col("middle") >= F.col("before")) & (F.col("middle") < F.col("before") + F.col("n")))
    met = valid.join(at.select("tile_id", "row", (F.col("middle") - F.col("before")).alias("offset")), ["tile_id", "row"])
    nth = F.row_number().over(Window.partitionBy("tile_id", "row").orderBy("col")) - 1
    return met.withColumn("nth", nth).where(F.col("nth") == F.col("offset")).drop("nth", "offset")
