"""Mix sources to target weights by Pareto order sampling, with DataFrame functions only.

Each source has a target number of words. A document's expected copies are its relative weight times a level that makes
the words expected of its source equal the target, and never more than ``MOST_COPIES``. The whole part of that number is
certain; the rest is its inclusion probability. Documents are ranked by the odds of a hashed uniform number divided by
their inclusion odds, and the ranking is cut where the words taken come nearest to what the certain copies leave of the
target: a sample of fixed size in words with unequal probabilities.

No source is ever gathered in one task. The rank key is cut into bins; sums by source and bin say in which bin the cut
lies, and only that bin's documents are put in order. The decision on a document is then a comparison with one row of a
table that has a row for each source and weight class.

Defined cases: null text or a text without words has size 0 and is never worth words; a null source is a source of its
own, last in order; the uniform number comes from id, text and, where rows repeat both, a number among the repeats, so
rows of one id or of none are drawn each for itself; weights count as the nearest power of two within ``WEIGHT_STEPS`` of
1, a null weight as 1 and a weight of 0 or less is never taken; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.rows import whole_row
from tilewright.functions.text import filled, word_count
from tilewright.llm.sized import checked
from tilewright.scratch import materialize, temporary

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BINS = 4096
SEED = 17
WEIGHT_STEPS = 10
SHORT, LONG = 32, 8192  # documents below or from these sizes weigh half
_HASH_DIGITS = 13


def length_weight(size: Column) -> Column:
    """The relative weight of a document when no other is given: fragments and very long texts weigh half."""
    return F.when((size < SHORT) | (size >= LONG), F.lit(0.5)).otherwise(F.lit(1.0))


def uniform(doc_id: Column, digest: Column, tie: Column, seed: int) -> Column:
    """A number strictly between 0 and 1, the same on every run and engine."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), digest, tie.cast("string"))
    whole = F.conv(F.substring(F.md5(key), 1, _HASH_DIGITS), 16, 10).cast("long")
    return (whole.cast("double") + F.lit(0.5)) / F.lit(float(16**_HASH_DIGITS))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Target words by source, from ``sizes(source, size)``.

    The sources share the sum of all sizes by weight; a target stops at ``most`` times its source's size and the excess
    is shared again by weight. Sources in the order of ``most * size / weight`` reach their stop one after another, so
    the level at which sharing ends follows from running sums. One row a source: the only table put in one order.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    choices = F.array(*[F.lit(float(w)) for w in weights])
    numbered = totals.withColumn("nth", F.row_number().over(in_order) - 1).withColumn(
        "weight", F.element_at(choices, (F.col("nth") % len(weights) + 1).cast("int"))
    )
    stop = F.lit(float(most)) * F.col("source_size")
    by_stop = Window.orderBy((stop / F.col("weight")), F.col("nth"))
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (
        F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum(stop).over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    levelled = numbered.withColumn("level", level).withColumn("stop", stop)
    # The level falls from the first source that stays below its stop; that first level holds for all later ones.
    final = F.max(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("level"))).over(whole)
    return levelled.withColumn("final", final).select(
        "source",
        "source_size",
        F.least(F.col("stop"), F.coalesce(F.col("final"), F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def _repeats(rows: DataFrame) -> DataFrame:
    """``of_id, of_digest`` of the pairs that more than one row has."""
    many = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1")
    return materialize(many.select(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest")), "mix-repeats")


def _tied(rows: DataFrame, repeats: DataFrame, any_repeat: bool) -> DataFrame:
    """``rows(doc_id, digest, ...)`` with ``tie``: 1, or a row's number among those that repeat its id and text.

    Repeats are numbered part by part of a written table, with the counts of the parts before, so no group meets in one task.
    """
    if not any_repeat:
        return rows.withColumn("tie", F.lit(1).cast("long"))
    same = rows["doc_id"].eqNullSafe(repeats["of_id"]) & (rows["digest"] == repeats["of_digest"])
    few = checked(repeats, 64)
    alone = rows.join(few, same, "left_anti").withColumn("tie", F.lit(1).cast("long"))
    found = rows.join(few, same, "left_semi").withColumn("part_of", F.spark_partition_id())
    found = materialize(found, "mix-repeated")
    counts = found.groupBy("doc_id", "digest", "part_of").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("doc_id", "digest").orderBy("part_of").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"c_{c}") for c in ("doc_id", "digest", "part_of")], "before")
    inside = Window.partitionBy("doc_id", "digest", "part_of").orderBy(F.lit(0))
    met = found.withColumn("nth", F.row_number().over(inside)).join(
        counts,
        F.col("doc_id").eqNullSafe(F.col("c_doc_id")) & (F.col("digest") == F.col("c_digest")) & (F.col("part_of") == F.col("c_part_of")),
    )
    numbered = met.withColumn("tie", F.col("nth") + F.col("before")).select(*alone.columns)
    return alone.unionByName(numbered)


def _step(weight: Column) -> Column:
    """The power of two nearest to a weight; 0 for one that is never taken."""
    whole = F.greatest(F.least(F.round(F.log2(F.greatest(weight, F.lit(1e-300)))), F.lit(float(WEIGHT_STEPS))), F.lit(-float(WEIGHT_STEPS)))
    return F.when(weight.isNull(), F.lit(1.0)).when(weight > 0, F.pow(F.lit(2.0), whole)).otherwise(F.lit(0.0))


def _rows(docs: DataFrame, weight: str | None, *more: Column) -> DataFrame:
    text = filled(F.col("text"))
    size = word_count(F.col("text"))
    pull = _step(F.col(weight).cast("double")) if weight else length_weight(size)
    return docs.select(*more, F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.md5(text).alias("digest"), size.alias("size"), pull.alias("pull"))


def class_plan(sized: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """A row for each source and weight: ``source, pull, source_size, target, copies, chance``."""
    classes = materialize(sized.groupBy("source", "pull").agg(F.sum("size").alias("size")), "mix-classes")
    targets = source_targets(classes, weights, most).withColumnRenamed("source", "of_source")
    met = classes.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    heavy = Window.partitionBy("source").orderBy(F.col("pull").desc())
    before = heavy.rowsBetween(Window.unboundedPreceding, -1)
    onward = heavy.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    drawn = F.sum(F.col("pull") * F.col("size")).over(onward)
    left = F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("size").over(before), F.lit(0))
    level = F.when(drawn > 0, left / drawn)
    levelled = met.withColumn("level", level)
    final = F.max(F.when(F.col("level") * F.col("pull") <= most, F.col("level"))).over(Window.partitionBy("source"))
    expected = F.when(F.col("final").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.col("final") * F.col("pull")))
    expected = F.when((F.col("source_size") > 0) & (F.col("pull") > 0), expected).otherwise(F.lit(0.0))
    placed = levelled.withColumn("final", final).withColumn("expected", expected).withColumn("copies", F.floor("expected").cast("long"))
    return placed.select("source", "pull", "size", "source_size", "target", "copies", (F.col("expected") - F.col("copies")).alias("chance"))


def _ranked(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``rows`` with their part of the plan and ``key``, a rank between 0 and 1 (null where nothing is left to chance), and its ``bin``."""
    plan = plan.select(F.col("source").alias("p_source"), F.col("pull").alias("p_pull"), "source_size", "target", "copies", "chance")
    met = rows.join(checked(plan, 256), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("pull") == F.col("p_pull"))).drop("p_source", "p_pull")
    u = uniform(F.col("doc_id"), F.col("digest"), F.col("tie"), seed)
    odds = F.when(F.col("chance") > 0, F.col("chance") / (F.lit(1.0) - F.col("chance")))
    rank = u / (F.lit(1.0) - u) / odds
    key = rank / (F.lit(1.0) + rank)
    return met.withColumn("key", key).withColumn("bin", F.least(F.floor(F.col("key") * BINS), F.lit(BINS - 1)).cast("int"))


def cut_plan(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, cut_bin, cut_key``: where each source's ranking is cut; a source with nothing to draw has no row."""
    certain = plan.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("sure"))
    rests = certain.select(F.col("source").alias("r_source"), (F.col("target") - F.col("sure")).alias("rest"))
    by_bin = materialize(ranked.where("bin IS NOT NULL").groupBy("source", "bin").agg(F.sum("size").alias("size")), "mix-bins")
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = by_bin.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    last = F.col("bin") == F.max("bin").over(Window.partitionBy("source"))
    met = placed.withColumn("last", last).join(rests, F.col("source").eqNullSafe(F.col("r_source")))
    inside = (F.col("rest") > F.col("before")) & ((F.col("rest") <= F.col("before") + F.col("size")) | F.col("last"))
    cuts = met.where(inside).select(F.col("source").alias("c_source"), F.col("bin").alias("cut_bin"), "before", "rest")
    cuts = materialize(cuts, "mix-cuts")
    there = ranked.join(checked(cuts, 256), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bin") == F.col("cut_bin")))
    upto = Window.partitionBy("source").orderBy("key")
    gap = F.abs(F.col("before") + F.col("upto") - F.col("rest"))
    nearest = there.withColumn("upto", F.sum("size").over(upto)).where(gap < F.col("rest") - F.col("before"))
    nearest = nearest.groupBy("source").agg(F.min_by("key", F.struct(gap, "key")).alias("cut_key")).withColumnRenamed("source", "n_source")
    return cuts.join(nearest, F.col("c_source").eqNullSafe(F.col("n_source")), "left").select(F.col("c_source").alias("source"), "cut_bin", "cut_key")


def _with_copies(ranked: DataFrame, cuts: DataFrame) -> DataFrame:
    """``ranked`` with ``n_copies``, how often the mix takes each document."""
    cuts = cuts.withColumnRenamed("source", "c_source")
    drawn = F.coalesce((F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.col("key") <= F.col("cut_key"))), F.lit(False))
    met = ranked.join(checked(cuts, 256), F.col("source").eqNullSafe(F.col("c_source")), "left")
    return met.withColumn("n_copies", F.col("copies") + drawn.cast("long"))


def _plans(docs: DataFrame, weights: tuple[float, ...], most: int, seed: int, weight: str | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The plan by source and weight, the cuts, the repeated pairs and the ranked sizes."""
    narrow = materialize(_rows(docs, weight), "mix-narrow")
    repeats = _repeats(narrow)
    sized = materialize(_tied(narrow, repeats, repeats.count() > 0), "mix-sizes")
    plan = materialize(class_plan(sized, weights, most), "mix-plan")
    ranked = _ranked(sized, plan, seed)
    return plan, materialize(cut_plan(ranked, plan), "mix-cut"), repeats, ranked


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, weight: str | None = None
) -> DataFrame:
    """A row for each document: ``doc_id, source, size, source_size, target, n_copies``.

    ``weight`` names a column of relative weights within a source; without it ``length_weight`` holds.
    """
    _, cuts, _, ranked = _plans(docs, weights, most, seed, weight)
    return _with_copies(ranked, cuts).select("doc_id", "source", "size", "source_size", "target", "n_copies")


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, weight: str | None = None
) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    The decision needs only the row and the small plan, so texts are not shuffled (those of repeated rows are written once).
    """
    with temporary() as tables:
        plan, cuts, repeats, _ = _plans(docs, weights, most, seed, weight)
        plan, cuts, repeats = tables.keep(plan, "mix-plan"), tables.keep(cuts, "mix-cut"), tables.keep(repeats, "mix-repeats")
    rows = _tied(_rows(docs, weight, whole_row(docs).alias("row")), repeats, repeats.count() > 0)
    taken = _with_copies(_ranked(rows, plan, seed), cuts).where("n_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))).select("row.*")
