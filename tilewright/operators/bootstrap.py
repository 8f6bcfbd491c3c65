"""Cluster bootstrap intervals of paired deltas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.scratch import materialize

DRAWS_AT_ONCE = 1 << 18  # eight megabytes of sums and their copies


def resampled(sums: np.ndarray, counts: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """``samples`` ratios of sums to counts over fields drawn with replacement, a bounded number of draws at a time."""
    rng, out = np.random.default_rng(seed), []
    step = max(1, DRAWS_AT_ONCE // max(1, len(counts)))
    for at in range(0, samples, step):
        drawn = rng.integers(0, len(counts), size=(min(step, samples - at), len(counts)))
        out.append(sums[drawn].sum(axis=1) / counts[drawn].sum(axis=1)[:, None])
    return np.concatenate(out)


def field_intervals(deltas: DataFrame, samples: int = 1000, seed: int = 17) -> DataFrame:
    """95 % intervals by category of ``deltas(category, field_id, recall_delta, map_delta)``.

    Rows are summed by field before a category meets in one task, so that task sees one row a field.
    """
    by_field = deltas.groupBy("category", "field_id").agg(F.sum("recall_delta").alias("r"), F.sum("map_delta").alias("m"), F.count("*").alias("n"))

    def interval(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("field_id")
        draws = resampled(frame[["r", "m"]].to_numpy(float), frame["n"].to_numpy(np.int64), samples, seed)
        low, high = np.quantile(draws, 0.025, axis=0), np.quantile(draws, 0.975, axis=0)
        return pd.DataFrame([[frame["category"].iloc[0], len(frame), low[0], high[0], low[1], high[1]]], columns=["category", "fields", "recall_low", "recall_high", "map_low", "map_high"])

    return by_field.groupBy("category").applyInPandas(interval, "category string, fields long, recall_low double, recall_high double, map_low double, map_high double")


def field_deltas(first: DataFrame, second: DataFrame, fields: DataFrame, samples: int = 1000, seed: int = 17) -> DataFrame:
    """Second minus first as one report: a row for each category with its 95 % intervals, and one, ``macro``, of the means over categories.

    ``first`` and ``second`` are ``(category, query_id, recall_at_k, ap_at_k)``, ``fields`` is ``(query_id, field_id)``; a
    query counts where both have it. Without ``samples`` intervals are null; without a category there is no macro row. A
    query without a field is an error, as it could not be drawn.
    """
    a = first.select(F.col("category").cast("string").alias("category"), "query_id", F.col("recall_at_k").alias("r1"), F.col("ap_at_k").alias("m1"))
    b = second.select(F.col("category").cast("string").alias("category"), "query_id", F.col("recall_at_k").alias("r2"), F.col("ap_at_k").alias("m2"))
    lost = F.raise_error(F.concat(F.lit("no field for the query "), F.col("query_id").cast("string"))).cast("string")
    met = a.join(b, ["category", "query_id"]).join(fields, "query_id", "left").select(
        "category", F.coalesce(F.col("field_id").cast("string"), lost).alias("field_id"), (F.col("r2") - F.col("r1")).alias("recall_delta"), (F.col("m2") - F.col("m1")).alias("map_delta"),
    )
    met = materialize(met, "paired-deltas")
    means = met.groupBy("category").agg(F.count("*").alias("paired_query_count"), F.avg("recall_delta").alias("recall_delta"), F.avg("map_delta").alias("map_delta"))
    bounds = ("fields", "recall_low", "recall_high", "map_low", "map_high")
    none = {c: F.lit(None).cast("long" if c == "fields" else "double") for c in bounds}
    rows = means.join(field_intervals(met, samples, seed), "category", "left") if samples else means.withColumns(none)
    rows = rows.withColumn("macro", F.lit(False))
    whole = means.agg(F.sum("paired_query_count").alias("paired_query_count"), F.avg("recall_delta").alias("recall_delta"), F.avg("map_delta").alias("map_delta"))
    macro = whole.where("paired_query_count IS NOT NULL").withColumns({**none, "category": F.lit(None).cast("string"), "macro": F.lit(True)})
    return rows.unionByName(macro).select("macro", "category", "paired_query_count", "recall_delta", "map_delta", *bounds)
