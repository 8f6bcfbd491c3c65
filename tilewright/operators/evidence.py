"""The evidence path: prefiltered prototype and example retrieval, and spectral ranking of scenes and of pairs of scenes.

Filters come before scoring. Every result tells its method, its measure, how many candidates there were before the cut,
and has a notice when they are fewer than asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import vectors
from tilewright.operators import request, search, spatial, spectral
from tilewright.scratch import materialize

# What results say of themselves.
MEDIAN, MEDIAN_CHANGE = "median_mndwi_rank", "median_delta_mndwi_rank"
HISTOGRAM, CHANGE_HISTOGRAM = "exact_index_histogram_cosine", "exact_change_histogram_cosine"
FLAT, FLAT_EXAMPLE = "exact_flat_cosine", "example_tile_exact_flat_cosine"
COSINE, INDEX_VALUE, SIGNED_CHANGE = "cosine similarity", "median MNDWI index value", "signed median MNDWI change"
NO_SCENES, FEW_SCENES, FEW_ITEMS = "No gallery scenes match these constraints.", "Only {} scene(s) matched.", "Only {} matching evidence item(s) were found."

SPECTRAL_INTENTS = ("spectral_water_signal", "spectral_water_increase", "spectral_water_decrease", "spectral_scene_similarity", "spectral_change_similarity")
MOST_DAYS = 30
BINS = 32
CELLS_A_TASK = 300_000


@dataclass(frozen=True)
class Evidence:
    """Ranked rows with what they are."""

    results: DataFrame
    method: str
    measure: str
    candidate_count: int
    notice: str | None


def matching(query: request.Query, ring: DataFrame | None, scenes: DataFrame, null_passes: bool) -> DataFrame:
    """``scenes(tile_id, timestamp, bbox, ...)`` inside the query's dates and place.

    ``ring(ring)`` is one row, the resolved place's outline, or ``ring(rings)`` one of several parts and holes, in any state
    of repair. A scene without a box fails against a place, one without a time against a bound; on the spectral path
    (``null_passes`` false) it fails always.
    """
    found = scenes.where(request.within_dates(F.col("timestamp"), query.start_date, query.end_date, null_passes))
    if ring is None:
        return found
    west, south, east, north = (F.get("bbox", k) for k in range(4))
    if "rings" in ring.columns:
        edges = ring.limit(1).select(spatial.edges_of(spatial.repaired(F.col("rings"))).alias("_edges"))  # one place
        near = found.where(F.size("bbox") >= 4).join(F.broadcast(edges))
        return near.where(spatial.edges_meet_bounds(F.col("_edges"), west, south, east, north)).drop("_edges")
    near = found.where(F.size("bbox") >= 4).join(F.broadcast(ring.limit(1)))  # one outline
    return near.where(request.ring_meets_bounds(F.col("ring"), west, south, east, north)).drop("ring")


def _found(scored: DataFrame, k: int, descending: bool, method: str, measure: str) -> Evidence:
    ranked = spectral.ranked(scored, k, descending, "tile_id")
    ranked = materialize(ranked, "evidence")
    first = ranked.select("candidate_count").first()
    count = first.candidate_count if first else 0
    notice = None if count >= k else FEW_ITEMS.format(count)
    return Evidence(ranked, method, measure, count, notice)


def scene_result(rows: DataFrame, description: str) -> DataFrame:
    """Evidence columns of ranked scenes: the first label or null, and where previews are served."""
    url = lambda end: F.concat(F.lit("/api/tiles/"), F.col("tile_id"), F.lit(end))
    return rows.select(
        "rank", "score", F.lit(description).alias("score_description"), "tile_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("after_date"), "sequence_id",
        "latitude", "longitude", F.get("labels", 0).alias("label"), url("/preview").alias("preview_url"), url("/indices/mndwi").alias("index_url"), "candidate_count",
    )


def pair_result(rows: DataFrame, description: str) -> DataFrame:
    """Evidence columns of ranked pairs; position and label are the later scene's."""
    url = lambda c, end: F.concat(F.lit("/api/tiles/"), F.col(c), F.lit(end))
    change = F.concat(F.lit("/api/tiles/"), F.col("before_id"), F.lit("/change/"), F.col("after_id"), F.lit("/mndwi"))
    return rows.select(
        "rank", "score", F.lit(description).alias("score_description"), F.col("before_id").alias("before_tile_id"), F.col("after_id").alias("after_tile_id"), "gap_days",
        "sequence_id", "latitude", "longitude", F.get("labels", 0).alias("label"), url("before_id", "/preview").alias("before_preview_url"),
        url("after_id", "/preview").alias("after_preview_url"), change.alias("change_map_url"), "candidate_count",
    )


def by_vector(query: request.Query, k: int, vector: DataFrame, gallery: DataFrame, scenes: DataFrame, ring: DataFrame | None = None, skip: str | None = None) -> Evidence:
    """Scenes of ``gallery(tile_id, embedding)`` by cosine to the one row of ``vector(embedding)``; filters come first.

    ``skip`` is an example tile: it alone is left out of its own results.
    """
    query.require_supported()
    inside = matching(query, ring, scenes.join(gallery.select("tile_id"), "tile_id", "left_semi"), True)
    if skip is not None:
        inside = inside.where(F.col("tile_id") != skip)
    inside = materialize(inside.select("tile_id"), "eligible")
    count = inside.count()
    asked = vector.select(F.lit("query").alias("query_id"), "embedding")
    hits = search.top_k(gallery.join(inside, "tile_id", "left_semi"), asked, min(k, max(1, count)), skip_self=False)
    met = hits.select("rank", "tile_id", "score").join(scenes, "tile_id").withColumn("candidate_count", F.lit(count))
    notice = NO_SCENES if not count else FEW_SCENES.format(count) if count < k else None
    return Evidence(met, FLAT if skip is None else FLAT_EXAMPLE, COSINE, count, notice)


def by_prototype(query: request.Query, k: int, gallery: DataFrame, support: DataFrame, scenes: DataFrame, modality: str, ring: DataFrame | None = None) -> Evidence:
    """Scenes nearest to the prototype of the query's class, made of ``support(label, embedding)`` alone."""
    if query.intent == "visual_similarity":
        raise ValueError("this intent needs an example tile")
    query.require_supported()
    query.require_modality(modality)
    mine = support.where(F.col("label") == query.intent)
    return by_vector(query, k, search.prototypes(mine).select("embedding"), gallery, scenes, ring)


def by_example(query: request.Query, k: int, example: str, gallery: DataFrame, scenes: DataFrame, modality: str, ring: DataFrame | None = None) -> Evidence:
    """Scenes nearest to an example tile of the gallery."""
    if query.intent == "unsupported" or query.unsupported_conditions:
        raise ValueError("nothing here answers these conditions")
    query.require_modality(modality)
    mine = gallery.where(F.col("tile_id") == example).select("embedding")
    if mine.isEmpty():
        raise KeyError(f"unknown or unavailable example tile: {example}")
    return by_vector(query if query.example_tile_id else _with_example(query, example), k, mine, gallery, scenes, ring, example)


def _with_example(query: request.Query, example: str) -> request.Query:
    values = {f: getattr(query, f) for f in query.__dataclass_fields__}
    return request.Query(**(values | {"example_tile_id": example}))


def _sequence_of(scenes: DataFrame, tile: str) -> str | None:
    row = scenes.where(F.col("tile_id") == tile).select("sequence_id").first()
    if row is None:
        raise KeyError(f"unknown or unavailable tile: {tile}")
    return row.sequence_id


def _other_sequences(rows: DataFrame, sequence: str | None) -> DataFrame:
    return rows.where(~F.coalesce(F.col("sequence_id") == sequence, F.lit(False)))


def _descriptor(rows: DataFrame, tile: Column) -> DataFrame:
    """The one row whose id is ``tile``, as ``example``."""
    return rows.where(tile).select(F.col("descriptor").alias("example"))


def spectral_evidence(
    ask: request.Request, scenes: DataFrame, maps: DataFrame, *cell: str, ring: DataFrame | None = None, every: DataFrame | None = None, most_days: int = MOST_DAYS, bins: int = BINS,
    tie_places: int | None = None,
) -> Evidence:
    """Scenes or pairs ranked by index evidence.

    ``scenes(tile_id, sequence_id, timestamp, bbox, latitude, longitude, labels)`` are the searchable ones, ``every`` all
    available ones (``scenes``, if None): an example pair must be consecutive among these. ``maps`` are index maps by
    ``tile_id`` and ``cell``. Pairs are made before filters, which look at the later scene only. Ranks go by the whole
    cosine, or with ``tie_places`` by so many places of it, so that sums in another order give the same ranks.
    """
    query, k = ask.query, ask.k
    if query.intent not in SPECTRAL_INTENTS or query.unsupported_conditions:
        raise ValueError("no spectral path answers: " + (", ".join(query.unsupported_conditions) or query.intent))
    if query.requested_modality == "rgb":
        raise ValueError("three visible bands carry no spectral evidence")
    query.require_supported()
    every = scenes if every is None else every
    before, after = ask.before_example_tile_id, ask.after_example_tile_id
    if query.intent in ("spectral_water_signal", "spectral_scene_similarity"):
        inside = matching(query, ring, scenes, False)
        if query.intent == "spectral_water_signal":
            summed = spectral.summaries(maps.select("tile_id", F.col("mndwi").alias("value")), "tile_id").where("valid_pixels > 0")
            scored = inside.join(summed.select("tile_id", F.col("median").alias("score")), "tile_id")
            return _found(scored, k, True, MEDIAN, INDEX_VALUE)
        if not before:
            raise ValueError("scene similarity needs an example tile")
        inside = _other_sequences(inside.where(F.col("tile_id") != before), _sequence_of(every, before))
        inside = materialize(inside, "eligible")
        # Descriptors are made of the scenes that may be ranked, and of the example, alone.
        asked = inside.select("tile_id").unionByName(scenes.sparkSession.createDataFrame([(before,)], "tile_id string"))
        maps = maps.join(asked, "tile_id", "left_semi")
        scored = _alike(maps, ("tile_id",), F.col("tile_id") == before, -1.0, 1.0, bins, "the example has no valid MNDWI pixels", tie_places)
        return _found(inside.join(scored, "tile_id"), k, True, HISTOGRAM, COSINE)
    pairs = spectral.temporal_pairs(scenes, most_days)
    if query.intent == "spectral_change_similarity":
        if not before or not after:
            raise ValueError("change similarity needs two example tiles")
        example = spectral.temporal_pairs(every, most_days).where((F.col("before_id") == before) & (F.col("after_id") == after))
        if example.isEmpty():
            raise ValueError(f"before_example_tile_id {before!r} and after_example_tile_id {after!r} are no pair of neighbours in one sequence, at most {most_days} days apart")
        pairs = _other_sequences(pairs, _sequence_of(every, before)).unionByName(example)
    later = matching(query, ring, scenes, False).withColumnRenamed("tile_id", "after_id").drop("sequence_id")
    # Maps are made of the pairs that may be ranked, and of the example, alone.
    later = materialize(later, "eligible")
    asked = pairs.join(later, "after_id", "left_semi")
    if query.intent == "spectral_change_similarity":
        asked = asked.unionByName(example).distinct()
    pairs = materialize(asked, "eligible-pairs")
    changes = spectral.change_maps(pairs, maps, *cell)
    if query.intent == "spectral_change_similarity":
        chosen = (F.col("before_id") == before) & (F.col("after_id") == after)
        scored = _alike(changes, ("before_id", "after_id"), chosen, -2.0, 2.0, bins, "the example pair has no shared valid MNDWI pixels", tie_places).where(~chosen)
        method, measure, down = CHANGE_HISTOGRAM, COSINE, True
    else:
        summed = spectral.summaries(changes.select("before_id", "after_id", F.col("mndwi").alias("value")), "before_id", "after_id")
        scored = summed.where("valid_pixels > 0").select("before_id", "after_id", F.col("median").alias("score"))
        method, measure, down = MEDIAN_CHANGE, SIGNED_CHANGE, query.intent != "spectral_water_decrease"
    met = scored.join(pairs, ["before_id", "after_id"]).join(later, "after_id").withColumn("tile_id", F.col("after_id"))
    return _found(met, k, down, method, measure)


def _alike(maps: DataFrame, keys: tuple[str, ...], chosen: Column, low: float, high: float, bins: int, said: str, places: int | None) -> DataFrame:
    """``keys, score``: cosine of each key's descriptor to the chosen one's; keys without valid MNDWI or mass take no part."""
    maps = materialize(maps.select(*keys, *spectral.INDEX_BANDS), "asked-maps")
    # Dealt by key, a fixed number of cells to a task: what a task counts does not grow with the table.
    maps = maps.repartition(max(1, -(-maps.count() // CELLS_A_TASK)), *keys)
    rows = spectral.histograms(spectral.long_maps(maps, *keys), low, high, bins, *keys)
    valid = maps.groupBy(*keys).agg(F.count("mndwi").alias("valid_pixels")).where("valid_pixels > 0").select(*keys)
    rows = materialize(rows.join(valid, list(keys), "left_semi"), "descriptors")  # written first, as each look at a descriptor would make it again
    rows = rows.where(vectors.norm(F.col("descriptor")) > 1e-12)
    one = _descriptor(rows, chosen)
    if one.isEmpty():
        raise ValueError(said)
    scored = rows.where(~chosen).crossJoin(F.broadcast(one.limit(1)))  # one descriptor
    score = vectors.cosine(F.col("descriptor"), F.col("example"))
    return scored.select(*keys, (score if places is None else F.round(score, places)).alias("score"))
