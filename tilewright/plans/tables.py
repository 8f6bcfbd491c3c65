"""The driver's tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CELLS_A_TASK = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as tiles: ``tile_id, label, embedding``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("tile_id"), "vec_id", "label", "embedding")


def asked(tiles: DataFrame) -> DataFrame:
    """Every tenth tile as a query."""
    return tiles.where("vec_id % 10 = 0").select(F.col("tile_id").alias("query_id"), F.col("label").alias("query_label"), "embedding")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pixels: a tile for each order, four bands, valid unless returned."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("tile_id"),
        F.col("l_suppkey").alias("group_id"),
        F.col("l_linenumber").alias("row"),
        (F.col("l_returnflag") != "R").alias("valid"),
        F.col("l_quantity").alias("b03"),
        (F.col("l_extendedprice") / 1000).alias("b04"),
        (F.col("l_tax") * 100).alias("b08"),
        (F.col("l_discount") * 100).alias("b11"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scenes: a sequence for each user."""
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.lpad(F.col("event_id").cast("string"), 9, "0").alias("tile_id"), F.col("user_id").cast("string").alias("sequence_id"), F.col("ts").alias("timestamp"), "value"
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tiles: id, label (language), group (source)."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").cast("string").alias("tile_id"), F.col("lang").alias("label"), F.col("source").alias("group_id"), "n_chars")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as countries and nations as their first-order parts."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    countries = region.select(
        F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("place_id"), F.lit("country").alias("level"), F.col("r_name").alias("name"),
        F.col("r_name").alias("country"), F.array(F.concat(F.lit("REGION "), F.col("r_regionkey").cast("string"))).alias("aliases"),
    )
    parts = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select(
        F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("place_id"), F.lit("admin1").alias("level"), F.col("n_name").alias("name"),
        F.col("r_name").alias("country"), F.array(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))).alias("aliases"),
    )
    return countries.unionByName(parts)


def scene_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as scenes (a sequence for each customer) and their lines' index maps by line number.

    ``scenes(tile_id, sequence_id, timestamp, bbox, latitude, longitude, labels)``; boxes come from the customer's number,
    every ninth is missing and every seventh crosses the antimeridian.
    """
    key = F.col("o_custkey")
    west = F.when(key % 7 == 0, F.lit(178.0)).otherwise((key % 360 - 180).cast("double"))
    east = F.when(key % 7 == 0, F.lit(-178.0)).otherwise(F.least(west + 2, F.lit(180.0)))
    south = (key % 160 - 80).cast("double")
    flood = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("flood"))).when(F.col("o_orderstatus") == "F", F.array(F.lit("no_flood"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("tile_id"), key.cast("string").alias("sequence_id"), F.col("o_orderdate").alias("timestamp"),
        F.when(key % 9 != 0, F.array(west, south, east, south + 2)).alias("bbox"), (south + 1).alias("latitude"), (west + 1).alias("longitude"), flood.alias("labels"),
    )
    cells = pixels(spark, sf_dir).withColumn("tile_id", F.lpad(F.col("tile_id").cast("string"), 9, "0")).drop("group_id")
    # Dealt by scene, a fixed number of lines to a task: what a task sorts does not grow with the table.
    cells = cells.repartition(max(1, -(-cells.count() // CELLS_A_TASK)), "tile_id")
    # Lines of an order may repeat a number; the first by its values stands for the cell.
    once = cells.groupBy("tile_id", "row").agg(F.min(F.struct("valid", "b03", "b04", "b08", "b11")).alias("one")).select("tile_id", "row", "one.*")
    return rows, once


def embedding_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as scenes with a day, a box and a label each."""
    key = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        key.cast("string").alias("tile_id"), F.floor(key / 10).cast("string").alias("sequence_id"),
        F.date_add(F.lit("1995-07-01").cast("date"), (key % 2000).cast("int")).cast("timestamp_ntz").alias("timestamp"),
        F.array(*[(x).cast("double") for x in (key % 300 - 150, key % 120 - 60, key % 300 - 148, key % 120 - 58)]).alias("bbox"),
        F.array(F.when(F.col("label") % 2 == 0, "flood").otherwise("no_flood")).alias("labels"), (key % 120 - 59).cast("double").alias("latitude"),
        (key % 300 - 149).cast("double").alias("longitude"), "embedding", "vec_id",
    )
