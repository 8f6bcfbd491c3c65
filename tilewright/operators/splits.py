"""Deterministic splits and samples by SHA-256 order, grouped splits, and their checks."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.digest import ordered_digest
from tilewright.functions.order import one_stream, placed_within

SPLITS = ("train", "validation", "test")


def stable_key(seed: int, name: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), name.cast("string")), 256)


def stratified(rows: DataFrame, fractions: tuple[float, float, float], seed: int) -> DataFrame:
    """``rows(tile_id, label, ...)`` with ``split``; labels keep the fractions, sizes round half to even."""
    placed = placed_within(rows, F.coalesce("label", F.lit("__all__")), stable_key(seed, F.col("tile_id")), F.col("tile_id"))
    place, total = F.col("place"), F.col("in_group")
    first = F.bround(total * F.lit(fractions[0]))
    second = first + F.bround(total * F.lit(fractions[1]))
    split = F.when(place <= first, SPLITS[0]).when(place <= second, SPLITS[1]).otherwise(SPLITS[2])
    return placed.withColumn("split", split).drop("place", "in_group")


def group_assignments(sizes: DataFrame, fractions: tuple[float, float, float], seed: int) -> DataFrame:
    """``group_id, split`` from ``sizes(group_id, n)``: largest group first, to the split furthest below its target.

    The fold is sequential by its definition: one task reads the sorted groups as a stream and holds three counts. Once
    as many groups are left as splits are empty, only empty splits are open.
    """
    known = sizes.agg(F.count("*").alias("groups"), F.sum("n").alias("rows")).first()
    targets = [(known["rows"] or 0) * f for f in fractions]
    groups = known["groups"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, left = [0, 0, 0], groups
        for batch in batches:
            out = []
            for n in batch.column("n").to_pylist():
                empty = [k for k in range(3) if counts[k] == 0]
                open_ = empty if left == len(empty) else range(3)
                pick = max(open_, key=lambda k: (targets[k] - counts[k], -k))
                counts[pick] += n
                left -= 1
                out.append(SPLITS[pick])
            yield pa.RecordBatch.from_arrays([batch.column("group_id"), pa.array(out, pa.string())], ["group_id", "split"])

    name = F.col("group_id").cast("string")
    keyed = sizes.select(name.alias("group_id"), F.col("n").cast("long").alias("n"), stable_key(seed, F.col("group_id")).alias("key"))
    in_order = one_stream(keyed, F.col("n").desc(), "key", "group_id").select("group_id", "n")
    return in_order.mapInArrow(fold, "group_id string, split string")


def grouped(rows: DataFrame, fractions: tuple[float, float, float], seed: int) -> DataFrame:
    """``rows(tile_id, group_id, ...)`` with ``split``; every group lies in one split. Needs three groups."""
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("n"))
    if sizes.limit(3).count() < 3:
        raise ValueError("at least three distinct groups are required")
    given = group_assignments(sizes, fractions, seed).withColumnRenamed("group_id", "of_group")
    return rows.join(given, F.col("group_id").cast("string") == F.col("of_group")).drop("of_group")


def support_groups(groups: list[tuple[str, int]], labels: dict[str, set[str]], needed: set[str], fraction: float, seed: int) -> set[str]:
    """Groups reserved as prototype examples: seeded order, taken while the count comes nearer to the fraction.

    ``groups`` are ``(id, rows)`` in first-seen order. Seeds are tried in turn until both sides show all ``needed`` labels.
    """
    if not 0.0 < fraction < 1.0:
        raise ValueError(f"fraction must lie between zero and one, not {fraction}")
    if len(groups) < 2:
        raise ValueError(f"at least two groups are required, not {len(groups)}")
    rows, target = dict(groups), round(sum(n for _, n in groups) * fraction)
    for at in range(seed, max(seed, 117) + 1):
        order = [g for g, _ in groups]
        random.Random(at).shuffle(order)
        chosen: set[str] = set()
        count = 0
        for group in order:
            if not count or abs(count + rows[group] - target) < abs(count - target):
                chosen.add(group)
                count += rows[group]
        sides = (chosen, set(rows) - chosen)
        if not sides[1]:
            raise ValueError("the split leaves nothing to search")
        if all(needed <= set().union(*(labels[g] for g in side)) for side in sides):
            return chosen
    raise ValueError("no seed shows every label on both sides")


def split_summary(rows: DataFrame) -> DataFrame:
    """Records, labels and groups by split, from ``rows(split, label, group_id)``."""
    return rows.groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("label").alias("labels"), F.count_distinct("group_id").alias("groups"))


def crossing_groups(rows: DataFrame) -> DataFrame:
    """Groups that lie in more than one split."""
    return rows.groupBy("group_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def fingerprint(rows: DataFrame) -> DataFrame:
    """SHA-256 over ``tile_id, NUL, split, LF`` of all rows in order of id."""
    name = F.col("tile_id").cast("string")
    return ordered_digest(rows, F.concat(name, F.lit("\0"), F.col("split"), F.lit("\n")), name)


def round_robin(rows: DataFrame, count: int, seed: int) -> DataFrame:
    """``count`` rows that cycle through the labels: first of each by key, then second of each, and so on."""
    placed = placed_within(rows, F.col("label"), stable_key(seed, F.col("tile_id")))
    return placed.withColumnRenamed("place", "depth").drop("in_group").orderBy("depth", "label").limit(count)


def tail_sample(rows: DataFrame, value: str, each: int, seed: int) -> DataFrame:
    """``each`` rows from the lowest and the highest quarter of each label, by key; a label of one row has only a low tail."""
    known = rows.where(F.col(value).isNotNull())
    placed = placed_within(known, F.col("label"), F.col(value), F.col("tile_id"))
    place, n = F.col("place"), F.col("in_group")
    quarter = F.greatest(F.lit(1), F.floor(n / 4))
    low, high = place <= quarter, (place > n - quarter) & (n > 1)
    tails = F.filter(F.array(F.when(low, F.lit("low")), F.when(high, F.lit("high"))), lambda t: t.isNotNull())
    sides = placed.withColumn("tail", F.explode(tails)).drop("place", "in_group")
    pick = placed_within(sides, F.struct("label", "tail"), stable_key(seed, F.col("tile_id")))
    return pick.where(F.col("place") <= each).drop("place", "in_group")


def rows_for_split(rows: DataFrame, splits: DataFrame, split: str, allow_extra: bool = False) -> DataFrame:
    """``rows`` of one split by ``splits(tile_id, split)``; ids on one side only are an error.

    With ``allow_extra`` the assignments may name ids that ``rows`` lack, but not the other way round.
    """
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, not {split!r}")
    require_known(rows, splits, "tile_id", "rows without an assignment")
    if not allow_extra:
        require_known(splits, rows, "tile_id", "assignments without a row")
    return rows.join(splits.where(F.col("split") == split).select("tile_id"), "tile_id", "left_semi")


def require_known(rows: DataFrame, known: DataFrame, key: str, said: str) -> None:
    """Raise if ``rows`` hold a key that ``known`` lacks; a few of them are named."""
    odd = rows.select(key).join(known.select(key), key, "left_anti").limit(3).collect()
    if odd:
        raise ValueError(f"{said}: {sorted(str(r[0]) for r in odd)}")


def require_apart(a: DataFrame, b: DataFrame, key: str, said: str) -> None:
    """Raise if the two share a key."""
    both = a.select(key).intersect(b.select(key)).limit(3).collect()
    if both:
        raise ValueError(f"{said}: {sorted(str(r[0]) for r in both)}")


def availability_summary(rows: DataFrame) -> DataFrame:
    """By split, from ``rows(split, asset_status, flooding, group_id)``: records, available, missing, flood, no_flood, groups."""
    flood = F.coalesce("flooding", F.lit(False))
    return rows.groupBy("split").agg(
        F.count("*").alias("records"),
        F.count_if(F.col("asset_status") == "available").alias("available_scenes"),
        F.count_if(~F.coalesce(F.col("asset_status") == "available", F.lit(False))).alias("missing_scenes"),
        F.count_if(flood).alias("flood"),
        F.count_if(~flood).alias("no_flood"),
        F.count_distinct("group_id").alias("sequence_groups"),
    )
