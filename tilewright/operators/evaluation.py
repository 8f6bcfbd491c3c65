"""Retrieval metrics from ranked lists, label agreement, preset choice and judgment bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def query_metrics(ranked: DataFrame, relevance: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """``category, query_id, hits, precision_at_k, recall_at_k, ap_at_k`` a query and category.

    ``ranked(query_id, category, rank, tile_id)`` holds the first ``k`` results, ``relevance(tile_id, category)`` what is
    relevant, ``totals(category, relevant)`` how many rows of the gallery are. Recall divides by all relevant rows,
    average precision by ``min(k, relevant)``; without relevant rows all three are 0.
    """
    marked = ranked.join(relevance.withColumn("hit", F.lit(1)), ["tile_id", "category"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    upto = Window.partitionBy("category", "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("so_far", F.sum("hit").over(upto))
    summed = marked.groupBy("category", "query_id").agg(
        F.sum("hit").alias("hits"), F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("precisions")
    )
    met = summed.join(totals, "category", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    some = F.col("relevant") > 0
    return met.select(
        "category",
        "query_id",
        "relevant",
        F.col("hits").cast("long").alias("hits"),
        (F.col("hits") / F.lit(float(k))).alias("precision_at_k"),
        F.when(some, F.col("hits") / F.greatest("relevant", F.lit(1))).otherwise(0.0).alias("recall_at_k"),
        F.when(some, F.col("precisions") / F.greatest(F.least(F.lit(k), "relevant"), F.lit(1))).otherwise(0.0).alias("ap_at_k"),
    )


def category_metrics(per_query: DataFrame, minimum: int = 1) -> DataFrame:
    """Means by category over queries with something to find, and how many; categories with fewer than ``minimum`` go."""
    found = per_query.where("relevant > 0").groupBy("category").agg(
        F.count("*").alias("queries"),
        F.avg("precision_at_k").alias("precision_at_k"),
        F.avg("recall_at_k").alias("recall_at_k"),
        F.avg("ap_at_k").alias("map_at_k"),
    )
    return found.where(F.col("queries") >= minimum)


def macro_metrics(by_category: DataFrame) -> DataFrame:
    """Means over categories; nulls without any."""
    return by_category.agg(
        F.count("*").alias("categories"),
        F.avg("precision_at_k").alias("precision_at_k"),
        F.avg("recall_at_k").alias("recall_at_k"),
        F.avg("map_at_k").alias("map_at_k"),
    )


def label_agreement(ranked: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """``label, k, queries, agreement`` from ``ranked(query_id, label, rank, match)``; a null label is all queries.

    One pass: matches up to each ``k`` by query, then classes and the whole together by grouping sets.
    """
    per = ranked.groupBy("query_id", "label").agg(*[F.avg(F.when(F.col("rank") <= k, F.col("match").cast("double"))).alias(f"a{k}") for k in ks])
    both = per.groupingSets([[F.col("label")], []], "label").agg(F.count("*").alias("queries"), *[F.avg(f"a{k}").alias(f"a{k}") for k in ks])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"a{k}").alias("agreement")) for k in ks])).alias("one")
    return both.select("label", "queries", pairs).select("label", F.col("one.k").alias("k"), "queries", F.col("one.agreement").alias("agreement"))


def family_presets(runs: DataFrame) -> DataFrame:
    """The chosen modality and run of each architecture from ``runs(run_id, architecture, modality, seed, score)``.

    Highest mean, then ``rgb``, then the modality's name; within it the run nearest to the mean, then the smaller seed.
    """
    family = Window.partitionBy("architecture", "modality")
    scored = runs.withColumn("mean", F.avg("score").over(family)).withColumn("sd", F.coalesce(F.stddev_samp("score").over(family), F.lit(0.0)))
    first = Window.partitionBy("architecture").orderBy(
        F.col("mean").desc(), (F.col("modality") != "rgb").cast("int"), "modality", F.abs(F.col("score") - F.col("mean")), "seed"
    )
    return scored.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("architecture", "modality", "run_id", "seed", "mean", "sd")


def paired_deltas(first: DataFrame, second: DataFrame) -> DataFrame:
    """``category, paired_query_count, recall_delta, map_delta``, second minus first over common queries."""
    a = first.select("category", "query_id", F.col("recall_at_k").alias("r1"), F.col("ap_at_k").alias("m1"))
    b = second.select("category", "query_id", F.col("recall_at_k").alias("r2"), F.col("ap_at_k").alias("m2"))
    return a.join(b, ["category", "query_id"]).groupBy("category").agg(
        F.count("*").alias("paired_query_count"), F.avg(F.col("r2") - F.col("r1")).alias("recall_delta"), F.avg(F.col("m2") - F.col("m1")).alias("map_delta")
    )


def judgment_bounds(judgments: DataFrame) -> DataFrame:
    """Decision counts, precision bounds and agreement a query, from ``(query_id, rank, target_label, labels, judgment)``."""
    is_ = lambda d: F.count_if(F.col("judgment") == d).cast("long")
    labelled = F.array_contains(F.split(F.coalesce("labels", F.lit("")), ","), F.col("target_label"))
    agrees = F.when(F.col("judgment") != "uncertain", (labelled == (F.col("judgment") == "relevant")).cast("double"))
    found = judgments.withColumn("agrees", agrees).groupBy("query_id").agg(
        F.count("*").alias("judged_count"),
        is_("relevant").alias("relevant"),
        is_("uncertain").alias("uncertain"),
        is_("not_relevant").alias("not_relevant"),
        F.avg("agrees").alias("agreement"),
    )
    return found.withColumn("precision_lower", F.col("relevant") / F.col("judged_count")).withColumn(
        "precision_upper", (F.col("relevant") + F.col("uncertain")) / F.col("judged_count")
    )


def macro_deltas(by_category: DataFrame) -> DataFrame:
    """Means over categories of ``paired_deltas`` and how many queries they rest on."""
    return by_category.agg(
        F.count("*").alias("categories"), F.sum("paired_query_count").alias("paired_query_count"),
        F.avg("recall_delta").alias("macro_recall_delta"), F.avg("map_delta").alias("macro_map_delta"),
    )


DECISIONS = ("relevant", "uncertain", "not_relevant")


def judgment_summary(judgments: DataFrame, expected: int) -> DataFrame:
    """One row over all judgments: status, decision counts, macro precision bounds, and agreement over all definite rows.

    A judgment outside ``DECISIONS`` is an error.
    """
    known = F.when(F.col("judgment").isin(*DECISIONS), F.col("judgment"))
    judgment = F.coalesce(known, F.raise_error(F.concat(F.lit("invalid judgment: "), F.coalesce("judgment", F.lit("null")))).cast("string"))
    by_query = judgment_bounds(judgments.withColumn("judgment", judgment))
    definite = F.col("relevant") + F.col("not_relevant")
    rows = by_query.agg(
        F.sum("judged_count").alias("judged_count"), F.count("*").alias("query_count"), *[F.sum(d).alias(d) for d in DECISIONS],
        F.avg("precision_lower").alias("macro_precision_lower"), F.avg("precision_upper").alias("macro_precision_upper"),
        (F.sum(F.col("agreement") * definite) / F.nullif(F.sum(definite), F.lit(0))).alias("agreement_on_definite"),
    )
    count = F.coalesce("judged_count", F.lit(0))
    return rows.withColumn("expected_count", F.lit(expected)).withColumn("status", F.when(count == expected, "complete").otherwise("partial"))


def cross_seed_summary(scores: DataFrame) -> DataFrame:
    """``architecture, modality, seeds, mean, sd`` from ``(architecture, modality, seed, label, agreement)``: labels, then seeds."""
    per_seed = scores.groupBy("architecture", "modality", "seed").agg(F.avg("agreement").alias("score"))
    return per_seed.groupBy("architecture", "modality").agg(
        F.count("*").alias("seeds"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd")
    )


def epoch_means(batches: DataFrame, *values: str) -> DataFrame:
    """``epoch`` and the mean of each value weighted by ``weight`` (anchors or tiles); null where nothing has weight."""
    total = F.sum("weight")
    each = [(F.sum(F.col(v) * F.col("weight")) / F.nullif(total.cast("double"), F.lit(0.0))).alias(v) for v in values]
    return batches.groupBy("epoch").agg(total.alias("weight"), *each)


def first_per_label(rows: DataFrame) -> DataFrame:
    """The first row of each label in order of ``nth``, by a running minimum rather than a sort of each label."""
    return rows.groupBy("label").agg(F.min_by(F.struct(*rows.columns), "nth").alias("one")).select("one.*")


def neighbour_queries(embeddings: DataFrame, query_id: str | None, k: int) -> tuple[DataFrame, DataFrame, int]:
    """Query, candidates and depth of a search run: the validation tile ``query_id`` (the first, if None) against all training tiles.

    ``k`` is no more than there are candidates. Another tile than one of validation is an error.
    """
    validation = embeddings.where("split = 'validation'")
    asked = validation.orderBy("row").limit(1) if query_id is None else validation.where(F.col("tile_id") == query_id)
    if asked.isEmpty():
        raise ValueError("the query must be a validation tile")
    train = embeddings.where("split = 'train'")
    return asked.select(F.col("tile_id").alias("query_id"), "embedding"), train, min(k, train.count())
