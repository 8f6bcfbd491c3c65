"""Places in an order, without a window over a group that may be large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.scratch import materialize


def one_stream(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` in ``order`` as one partition, for what is sequential by its definition.

    They are sorted within that partition, on disk where they are many: partitions that were sorted one by one and then
    coalesced come in no promised order.
    """
    return rows.repartition(1).sortWithinPartitions(*order)


def placed_within(rows: DataFrame, group: Column, *order: Column, ties: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``place`` (from 1) and ``in_group`` (the group's size), in ``order`` within ``group``.

    Columns named in ``ties`` come after ``order`` but bound no range, so they may hold long texts.

    Rows are sorted in ranges of group and order and numbered range by range; a group that holds a third of all rows is
    spread over many ranges, whose counts are added up. What is put in one window is a row for each range of a group.
    """
    keyed = rows.select(*[F.col(f"`{c}`") for c in rows.columns], group.alias("_group"), *[o.alias(f"_by{k}") for k, o in enumerate(order)])
    keys = ["_group", *[f"_by{k}" for k in range(len(order))]]
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys, *ties)
    numbered = ranged.drop(*keys[1:]).withColumn("_range", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = materialize(numbered, "placed")
    sums = placed.groupBy("_group", "_range").agg(F.min("_nth").alias("_from"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("in_group", F.sum("_n").over(Window.partitionBy("_group")))
    sums = sums.select(F.col("_group").alias("_g"), F.col("_range").alias("_r"), "_from", "_before", "in_group")
    met = placed.join(sums, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_nth") - F.col("_from") + F.col("_before") + 1).alias("place"), "in_group")
