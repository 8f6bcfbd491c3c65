"""Every registered query: an operator applied to the driver's tables. Doubles are rounded to six places."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions import vectors
from tilewright.operators import bootstrap, evaluation, raster, request, search, spectral, splits, statistics
from tilewright.plans import sql
from tilewright.plans.registry import QUERIES, query
from tilewright.plans.tables import asked, documents, gallery, pixels, places, scenes, table
from tilewright.sources import catalog, readers

FRACTIONS = (0.8, 0.1, 0.1)
INDICES = list(spectral.INDEX_BANDS)


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def rounded(df: DataFrame) -> DataFrame:
    """All doubles to six places, all counts to longs."""
    return df.select(*[r6(c).alias(c) if k in ("double", "float") else F.col(c).cast("long").alias(c) if k in ("int", "bigint") else F.col(c) for c, k in df.dtypes])


def _top(spark: SparkSession, sf_dir: str, k: int, metric: str = "cosine") -> DataFrame:
    tiles = gallery(spark, sf_dir)
    return search.top_k(tiles, asked(tiles), k, metric)


@query
def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_top(spark, sf_dir, 10))


@query
def knn_inner_product_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_top(spark, sf_dir, 10, "inner_product"))


@query
def knn_euclidean_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_top(spark, sf_dir, 10, "euclidean"))


@query
def knn_unnormalised_ip_vs_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First neighbour by inner product and by cosine when vectors differ in length."""
    scale = F.lit(1.0) + (F.col("vec_id") % 5)
    tiles = gallery(spark, sf_dir).withColumn("embedding", F.transform(vectors.doubles(F.col("embedding")), lambda x: x * scale))
    ip = search.top_k(tiles, asked(tiles), 1, "inner_product").select("query_id", F.col("tile_id").alias("ip_id"), F.col("score").alias("ip"))
    cos = search.top_k(tiles, asked(tiles), 1).select("query_id", F.col("tile_id").alias("cosine_id"), F.col("score").alias("cosine"))
    return rounded(ip.join(cos, "query_id"))


@query
def knn_filtered_by_label_and_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters come before scoring and reach the scan."""
    tiles = gallery(spark, sf_dir)
    return rounded(search.top_k(tiles.where("label IN (1, 3, 5) AND vec_id BETWEEN 50 AND 400"), asked(tiles), 5))


@query
def knn_neighbor_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalog.export_neighbours(_top(spark, sf_dir, 3), gallery(spark, sf_dir))
    return rounded(out.withColumn("score", r6(F.col("score").cast("double"))))


def _matched(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    tiles = gallery(spark, sf_dir)
    met = _top(spark, sf_dir, k).join(tiles.select("tile_id", F.col("label").alias("found")), "tile_id")
    return met.join(asked(tiles).select("query_id", F.col("query_label").alias("label")), "query_id")


@query
def knn_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = _matched(spark, sf_dir, 10).withColumn("match", F.col("found") == F.col("label"))
    return rounded(evaluation.label_agreement(matched, (1, 5, 10)))


def _pattern(spark: SparkSession, sf_dir: str, k: int = 10, metric: str = "cosine") -> DataFrame:
    tiles = gallery(spark, sf_dir)
    relevance = tiles.select("tile_id", F.col("label").alias("category"))
    categories = asked(tiles).select("query_id", F.col("query_label").alias("category"))
    totals = relevance.groupBy("category").agg(F.count("*").alias("all")).withColumn("relevant", F.col("all") - 1).drop("all")
    return evaluation.query_metrics(_top(spark, sf_dir, k, metric).join(categories, "query_id"), relevance, totals, k)


@query
def pattern_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.category_metrics(_pattern(spark, sf_dir)))


@query
def pattern_retrieval_macro_min_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.macro_metrics(evaluation.category_metrics(_pattern(spark, sf_dir), 5)))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth vector as a prompt with a wanted category; no tile is of categories 10 and 11."""
    tiles = gallery(spark, sf_dir)
    prompts = asked(tiles).select("query_id", (F.floor(F.col("query_id").cast("long") / 10) % 12).alias("category"), "embedding")
    relevance = tiles.select("tile_id", F.col("label").cast("long").alias("category"))
    totals = relevance.groupBy("category").agg(F.count("*").alias("relevant"))
    ranked = search.top_k(tiles, prompts, 10, skip_self=False).join(prompts.select("query_id", "category"), "query_id")
    return evaluation.query_metrics(ranked, relevance, totals, 10)


@query
def text_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_prompts(spark, sf_dir))


@query
def text_retrieval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.macro_metrics(evaluation.category_metrics(_prompts(spark, sf_dir))))


@query
def multilabel_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several labels a row: its own and whether its id is a multiple of three; a query counts once a label."""
    tiles = gallery(spark, sf_dir)
    labels = F.concat(F.array(F.col("label").cast("string")), F.when(F.col("vec_id") % 3 == 0, F.array(F.lit("third"))).otherwise(F.array().cast("array<string>")))
    relevance = tiles.select("tile_id", F.explode(labels).alias("category"))
    totals = relevance.groupBy("category").agg((F.count("*") - 1).alias("relevant"))
    wanted = relevance.withColumnRenamed("tile_id", "query_id")
    return rounded(evaluation.category_metrics(evaluation.query_metrics(_top(spark, sf_dir, 10).join(wanted, "query_id"), relevance, totals, 10)))


def _support(tiles: DataFrame) -> DataFrame:
    return tiles.where("vec_id % 5 = 0")


@query
def class_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = search.prototypes(_support(gallery(spark, sf_dir)))
    return rounded(made.select("label", F.posexplode("embedding").alias("pos", "value")))


def _prototype_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = gallery(spark, sf_dir)
    made = search.prototypes(_support(tiles)).select(F.col("label").cast("string").alias("query_id"), "embedding")
    return search.top_k(tiles.where("vec_id % 5 <> 0"), made, 10, skip_self=False)


@query
def prototype_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_prototype_hits(spark, sf_dir))


@query
def prototype_precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = _prototype_hits(spark, sf_dir).join(gallery(spark, sf_dir).select("tile_id", "label"), "tile_id")
    return rounded(met.groupBy("query_id").agg(F.avg((F.col("label").cast("string") == F.col("query_id")).cast("double")).alias("precision_at_k")))


@query
def family_preset_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs made of embedding labels: two architectures, two modalities, scores from a component of the vectors."""
    runs = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("run"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("run_id"),
        F.when(F.col("vec_id") % 2 == 0, "cnn").otherwise("vit").alias("architecture"),
        F.when(F.col("vec_id") % 3 == 0, "rgb").otherwise("s2_12band").alias("modality"),
        F.col("vec_id").alias("seed"),
        F.col("embedding")[0].cast("double").alias("score"),
    )
    return rounded(evaluation.family_presets(runs))


def _delta_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tiles = gallery(spark, sf_dir)
    half = tiles.withColumn("embedding", F.slice("embedding", 1, 32))
    relevance = tiles.select("tile_id", F.col("label").alias("category"))
    categories = asked(tiles).select("query_id", F.col("query_label").alias("category"))
    totals = relevance.groupBy("category").agg((F.count("*") - 1).alias("relevant"))
    first = search.top_k(half, asked(half), 10).join(categories, "query_id")
    return evaluation.query_metrics(first, relevance, totals, 10), _pattern(spark, sf_dir)


@query
def paired_metric_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.paired_deltas(*_delta_rows(spark, sf_dir)))


@query
def field_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _delta_rows(spark, sf_dir)
    a = first.select("category", "query_id", F.col("recall_at_k").alias("r1"), F.col("ap_at_k").alias("m1"))
    met = a.join(second, ["category", "query_id"]).select(
        "category", F.concat(F.lit("f"), F.floor(F.col("query_id").cast("long") / 50).cast("string")).alias("field_id"),
        (F.col("recall_at_k") - F.col("r1")).alias("recall_delta"), (F.col("ap_at_k") - F.col("m1")).alias("map_delta"),
    )
    return rounded(bootstrap.field_intervals(met.withColumn("category", F.col("category").cast("string"))))


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.index_maps(pixels(spark, sf_dir))


@query
def spectral_index_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_maps(spark, sf_dir).select("tile_id", "row", *INDICES))


@query
def spectral_scene_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectral.index_summaries(_maps(spark, sf_dir), "tile_id"))


def _descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.histograms(spectral.long_maps(_maps(spark, sf_dir), "group_id"), -1.0, 1.0, 32, "group_id")


@query
def spectral_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_descriptors(spark, sf_dir).select("group_id", F.posexplode("descriptor").alias("pos", "share")))


@query
def spectral_histogram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups most like group 1; a descriptor without mass takes no part."""
    rows = _descriptors(spark, sf_dir).where(vectors.norm(F.col("descriptor")) > 1e-12)
    one = rows.where("group_id = 1").select(F.col("descriptor").alias("example"))
    scored = rows.where("group_id <> 1").crossJoin(F.broadcast(one)).select("group_id", F.round(vectors.cosine(F.col("descriptor"), F.col("example")), 9).alias("score"))
    return rounded(spectral.ranked(scored, 10, True, "group_id"))


@query
def water_signal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectral.summaries(_maps(spark, sf_dir).select("tile_id", F.col("mndwi").alias("value")), "tile_id").where("valid_pixels > 0")
    return rounded(spectral.ranked(found.select("tile_id", F.col("median").alias("score"), "valid_pixels"), 20, True, "tile_id"))


@query
def temporal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectral.temporal_pairs(scenes(spark, sf_dir), 30))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs first, then filters, which look at the later scene only."""
    pairs = spectral.temporal_pairs(scenes(spark, sf_dir), 30, "value", "timestamp")
    inside = request.within_dates(F.col("after_timestamp"), dt.date(2024, 1, 5), dt.date(2024, 1, 25), null_passes=False)
    return pairs.where(inside).select("before_id", "after_id", "gap_days", (F.col("after_value") - F.col("before_value")).alias("score"))


@query
def temporal_change_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectral.ranked(_changes(spark, sf_dir), 20, True, "after_id"))


@query
def temporal_change_decrease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectral.ranked(_changes(spark, sf_dir), 20, False, "after_id"))


@query
def change_histogram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index change from each line of an order to the next, as histograms over [-2, 2] by supplier, likened to supplier 1."""
    order = Window.partitionBy("tile_id").orderBy("row", "group_id", "b04", "b03")
    maps = _maps(spark, sf_dir)
    deltas = maps.select("group_id", *[(F.col(n) - F.lag(n).over(order)).alias(n) for n in INDICES])
    rows = spectral.histograms(spectral.long_maps(deltas, "group_id"), -2.0, 2.0, 32, "group_id").where(vectors.norm(F.col("descriptor")) > 1e-12)
    one = rows.where("group_id = 1").select(F.col("descriptor").alias("example"))
    scored = rows.where("group_id <> 1").crossJoin(F.broadcast(one)).select("group_id", F.round(vectors.cosine(F.col("descriptor"), F.col("example")), 9).alias("score"))
    return rounded(spectral.ranked(scored, 10, True, "group_id"))


@query
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified(documents(spark, sf_dir), FRACTIONS, 17).select("tile_id", "label", "split")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("tile_id"), F.col("c_nationkey").cast("string").alias("group_id"), F.col("c_mktsegment").alias("label"))


@query
def split_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.grouped(_customers(spark, sf_dir), FRACTIONS, 17).select("tile_id", "group_id", "split")


@query
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(splits.split_summary(splits.stratified(documents(spark, sf_dir), FRACTIONS, 17)))


@query
def split_integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(splits.crossing_groups(splits.stratified(documents(spark, sf_dir), FRACTIONS, 17)))


@query
def split_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.fingerprint(splits.stratified(documents(spark, sf_dir), FRACTIONS, 17))


@query
def prototype_support_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of ten embeddings; labels by parity. Only the group table reaches the driver."""
    tiles = gallery(spark, sf_dir).withColumn("sequence_id", F.floor(F.col("vec_id") / 10).cast("string"))
    groups = tiles.groupBy("sequence_id").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("n"), F.collect_set(F.when(F.col("label") % 2 == 0, "flood").otherwise("no_flood")).alias("labels")
    )
    rows = groups.orderBy("first").collect()
    chosen = splits.support_groups([(r.sequence_id, r.n) for r in rows], {r.sequence_id: set(r.labels) for r in rows}, {"flood", "no_flood"}, 0.2, 17)
    side = spark.createDataFrame([(g,) for g in sorted(chosen)], "sequence_id string").withColumn("role", F.lit("support"))
    return tiles.join(side, "sequence_id", "left").select("tile_id", "sequence_id", F.coalesce("role", F.lit("gallery")).alias("role"))


@query
def balanced_round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(splits.round_robin(documents(spark, sf_dir), 50, 17).select("tile_id", "label", "depth"))


@query
def stratified_tail_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = met.select(F.col("doc_id").cast("string").alias("tile_id"), F.col("quality").alias("label"), "n_chars")
    return rounded(splits.tail_sample(rows, "n_chars", 5, 17).select("tile_id", "label", "tail", "n_chars"))


@query
def band_statistics_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("band"), F.floor("l_extendedprice").cast("int").alias("value"))
    return rounded(statistics.band_statistics(rows, nodata=1000))


@query
def masked_band_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("value")) for b in ("b03", "b04", "b08", "b11")])).alias("one")
    rows = pixels(spark, sf_dir).select("valid", bands).select("valid", "one.*")
    return rounded(statistics.masked_moments(rows))


@query
def zscore_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels(spark, sf_dir)
    moments = rows.where("valid").agg(F.avg("b03").alias("m"), F.greatest(F.stddev_pop("b03"), F.lit(1e-12)).alias("s"))
    z = statistics.standardized(F.col("b03"), F.col("m"), F.col("s"), F.col("valid"))
    return rounded(rows.crossJoin(F.broadcast(moments)).select("tile_id", "row", z.alias("z")))


@query
def metadata_summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.metadata_summary(splits.stratified(documents(spark, sf_dir), FRACTIONS, 17)))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.scene_measurements(_maps(spark, sf_dir), ["b08", "b11"], INDICES)


@query
def scene_audit_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_measured(spark, sf_dir))


@query
def scene_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.scene_audit(_measured(spark, sf_dir), INDICES))


@query
def judgment_precision_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(
        (F.col("doc_id") % 20).alias("query_id"), F.col("doc_id").alias("rank"), F.lit("toxic").alias("target_label"),
        F.when(F.col("toxic") == 1, "toxic,text").otherwise("text").alias("labels"),
        F.when(F.col("quality") == 0, "uncertain").when(F.col("doc_id") % 3 == 0, "relevant").otherwise("not_relevant").alias("judgment"),
    )
    return rounded(evaluation.judgment_bounds(rows))


@query
def place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(request.find_places(places(spark, sf_dir), "nation_1", limit=20))


@query
def place_search_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(request.find_places(places(spark, sf_dir), "nation", level="admin1", country="region 2", limit=20))


@query
def tile_catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = table(spark, sf_dir, "customer").select(F.col("c_name").alias("tile_id"), F.col("c_mktsegment").alias("label"))
    return request.find_tiles(tiles, "0001", 200)


@query
def bbox_intersect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from customer keys, every seventh across the antimeridian, against a box that crosses it too."""
    key = F.col("c_custkey")
    west = F.when(key % 7 == 0, F.lit(178.0)).otherwise((key % 360 - 180).cast("double"))
    east = F.when(key % 7 == 0, F.lit(-178.0)).otherwise(F.least(west + 2, F.lit(180.0)))
    south = (key % 160 - 80).cast("double")
    boxes = table(spark, sf_dir, "customer").select(key.alias("tile_id"), west.alias("west"), south.alias("south"), east.alias("east"), (south + 2).alias("north"))
    return rounded(boxes.where(request.boxes_meet(F.col("west"), F.col("south"), F.col("east"), F.col("north"), (170.0, -40.0, -170.0, 40.0))))


@query
def pair_source_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    sources = table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")
    return rounded(catalog.pair_items(sources, labels.select("doc_id", "quality", "toxic"), "doc_id"))


@query
def missing_asset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scenes, line numbers as their bands; a scene of fewer than seven lines lacks some."""
    tiles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tile_id"))
    assets = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tile_id"), F.concat(F.lit("B0"), F.col("l_linenumber").cast("string")).alias("band"))
    found = catalog.missing_bands(tiles, assets, tuple(f"B0{k}" for k in range(1, 8)))
    return found.select("tile_id", F.array_join("missing_bands", ",").alias("missing"), "asset_status")


@query
def duplicate_key_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return rounded(catalog.duplicate_keys(rows, "user_id", "day"))


@query
def id_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.id_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("tile_id"), (F.floor(key / 16) % 16).cast("int").alias("row"), (key % 16).cast("int").alias("col"),
        (F.col("l_returnflag") != "R").alias("valid"), F.col("l_extendedprice").alias("value"), key.alias("cell"),
    )


@query
def d4_transform_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.d4_views(_grid(spark, sf_dir), 16).select("tile_id", "cell", "quarter_turns", "flipped", "row", "col"))


@query
def percentile_stretch_uint8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.stretched_bytes(_grid(spark, sf_dir), "value").select("tile_id", "cell", "stretched"))


@query
def nt_xent_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean contrastive loss and top-1 accuracy of pairs ``(2i, 2i + 1)``, in batches of 128 by id, at temperature 0.1."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 128).alias("batch"), vectors.unit(F.col("embedding")).alias("z"))
    a = rows.select("batch", F.col("vec_id").alias("i"), F.col("z").alias("zi"))
    b = rows.select("batch", F.col("vec_id").alias("j"), F.col("z").alias("zj"))
    logits = a.join(b, "batch").where("i <> j").select("i", "j", (vectors.dot(F.col("zi"), F.col("zj")) / 0.1).alias("s"))
    partner = F.when(F.col("i") % 2 == 0, F.col("i") + 1).otherwise(F.col("i") - 1)
    top = logits.withColumn("m", F.max("s").over(Window.partitionBy("i")))
    per = top.groupBy("i").agg(
        (F.max("m") + F.log(F.sum(F.exp(F.col("s") - F.col("m")))) - F.max(F.when(F.col("j") == partner, F.col("s")))).alias("loss"),
        (F.max(F.when(F.col("j") == partner, F.col("s"))) == F.max("m")).cast("double").alias("hit"),
    )
    return rounded(per.agg(F.count("*").alias("anchors"), F.avg("loss").alias("loss"), F.avg("hit").alias("accuracy")))


@query
def json_metadata_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("with_k"), F.sum(k).alias("total_k"), F.max(k).alias("most_k")))


@query
def multilabel_from_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as mask pixels: the class by line number, set where discounted, inside the field unless returned."""
    names = F.array(*[F.lit(c) for c in readers.ANOMALIES])
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tile_id"), F.element_at(names, (F.col("l_linenumber") % 9 + 1).cast("int")).alias("category"),
        (F.col("l_discount") >= 0.05).cast("int").alias("mask"), (F.col("l_returnflag") != "R").cast("int").alias("field"),
        (F.col("l_linestatus") == "O").cast("int").alias("boundary"),
    )
    return readers.mask_labels(rows, readers.ANOMALIES).select("tile_id", F.array_join("labels", ",").alias("labels"))


@query
def gazetteer_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as shapes: every fifth without a code, alternatives split on bars and semicolons."""
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nth"), F.lit("admin1").alias("level"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("N"), (F.col("n_nationkey") % 7).cast("string"))).alias("code"),
        F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("country"),
        F.concat(F.col("n_name"), F.lit(" | x;"), F.col("n_name"), F.lit(";; y "), F.col("n_regionkey").cast("string")).alias("alternatives"),
    )
    return readers.gazetteer_rows(rows).select("place_id", "level", "name", "country", F.array_join("aliases", ",").alias("aliases"))


@query
def asset_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as asset names, a map with one of them for each event."""
    items = table(spark, sf_dir, "events").select(F.create_map(F.col("event_type"), F.col("props")).alias("assets"))
    return rounded(readers.asset_counts(items))


SQL = sql.SQL

from tilewright.plans import files, more, wide  # noqa: E402, F401  register their queries here
