"""Further queries, each beside the SQL that says what it returns: evidence, joins and checks, summaries, columns, rasters, artifacts."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geo, names
from tilewright.functions.digest import ordered_digest
from tilewright.functions.order import placed_within
from tilewright.operators import augment, encoders, evaluation, evidence, raster, request, search, spectral, splits, statistics, views
from tilewright.plans import sql as base
from tilewright.plans.queries import FRACTIONS, _customers, _delta_rows, _grid, _top, rounded
from tilewright.plans.registry import query, said
from tilewright.plans.sql import SQL
from tilewright.plans.tables import documents, embedding_scenes, gallery, pixels, scene_tables, table
from tilewright.scratch import fresh_path, materialize
from tilewright.sources import catalog, readers, sinks


# Evidence ------------------------------------------------------------------------------------------------------------

START, END = dt.date(1996, 1, 1), dt.date(1999, 12, 31)
RING = [(-120.0, -60.0), (150.0, -70.0), (179.0, 10.0), (100.0, 75.0), (-20.0, 20.0), (-140.0, 70.0)]


def _ring(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([([{"x": x, "y": y} for x, y in RING],)], "ring array<struct<x:double,y:double>>")


def _ask(intent: str, **values: object) -> request.Query:
    return request.Query(intent, "a made query", START, END, "Somewhere", "country", resolved_place_id="somewhere", **values)


_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(RING, [*RING[1:], RING[0]], strict=True))
# A box meets the ring: a vertex inside, its first corner in the ring, or an edge that crosses one of its sides or lies inside.
_PLACE = f"""ed(x1, y1, x2, y2) AS (VALUES {_EDGES}),
bx AS (SELECT tile_id, unnest(CASE WHEN bbox[1] > bbox[3] THEN [[bbox[1], bbox[2], 180.0, bbox[4]], [-180.0, bbox[2], bbox[3], bbox[4]]] ELSE [bbox] END) AS b FROM sn WHERE bbox IS NOT NULL),
sd AS (SELECT tile_id, b, unnest([[b[1], b[2], b[3], b[2]], [b[3], b[2], b[3], b[4]], [b[3], b[4], b[1], b[4]], [b[1], b[4], b[1], b[2]]]) AS s FROM bx),
cr AS (SELECT DISTINCT tile_id FROM sd, ed WHERE
  ((s[3] - s[1]) * (y1 - s[2]) - (s[4] - s[2]) * (x1 - s[1])) * ((s[3] - s[1]) * (y2 - s[2]) - (s[4] - s[2]) * (x2 - s[1])) <= 0
  AND ((x2 - x1) * (s[2] - y1) - (y2 - y1) * (s[1] - x1)) * ((x2 - x1) * (s[4] - y1) - (y2 - y1) * (s[3] - x1)) <= 0),
vi AS (SELECT DISTINCT tile_id FROM bx, ed WHERE x1 BETWEEN b[1] AND b[3] AND y1 BETWEEN b[2] AND b[4]),
co AS (SELECT tile_id FROM bx, ed GROUP BY tile_id, b HAVING count(*) FILTER ((y1 > b[2]) <> (y2 > b[2]) AND b[1] < (x2 - x1) * (b[2] - y1) / (y2 - y1) + x1) % 2 = 1),
pl AS (SELECT tile_id FROM cr UNION SELECT tile_id FROM vi UNION SELECT tile_id FROM co)"""
_SCENES = f"""sn AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS tile_id, CAST(o_custkey AS VARCHAR) AS sequence_id, o_orderdate AS ts,
  CASE WHEN o_custkey % 9 <> 0 THEN [CASE WHEN o_custkey % 7 = 0 THEN 178.0 ELSE o_custkey % 360 - 180 END::DOUBLE, (o_custkey % 160 - 80)::DOUBLE,
    CASE WHEN o_custkey % 7 = 0 THEN -178.0 ELSE least(o_custkey % 360 - 178, 180.0) END::DOUBLE, (o_custkey % 160 - 78)::DOUBLE] END AS bbox,
  (o_custkey % 160 - 79)::DOUBLE AS latitude, (CASE WHEN o_custkey % 7 = 0 THEN 179.0 ELSE o_custkey % 360 - 179 END)::DOUBLE AS longitude,
  CASE o_orderstatus WHEN 'O' THEN 'flood' WHEN 'F' THEN 'no_flood' END AS label FROM orders),
p0 AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS tile_id, CAST(l_linenumber AS BIGINT) AS "row", l_returnflag <> 'R' AS valid, l_quantity AS b03, l_extendedprice / 1000 AS b04, l_tax * 100 AS b08, l_discount * 100 AS b11 FROM lineitem),
p1 AS (SELECT *, row_number() OVER (PARTITION BY tile_id, "row" ORDER BY valid, b03, b04, b08, b11) AS nth FROM p0),
px AS (SELECT * FROM p1 WHERE nth = 1),
maps AS (SELECT tile_id, "row", CASE WHEN valid AND abs(b03 + b08) > 1e-6 THEN (b03 - b08) / (b03 + b08) END AS ndwi, CASE WHEN valid AND abs(b03 + b11) > 1e-6 THEN (b03 - b11) / (b03 + b11) END AS mndwi,
  CASE WHEN valid AND abs(b08 + b04) > 1e-6 THEN (b08 - b04) / (b08 + b04) END AS ndvi FROM px),
{_PLACE},
el AS (SELECT * FROM sn WHERE ts >= DATE '{START}' AND ts < DATE '{END + dt.timedelta(days=1)}' AND tile_id IN (SELECT tile_id FROM pl))"""
_RANKED = """SELECT row_number() OVER (ORDER BY score {way}, tile_id) AS rank, round(score, 6) + 0.0 AS score, tile_id, sequence_id, label, latitude, longitude,
'/api/tiles/' || tile_id || '/preview' AS preview_url, (SELECT count(*) FROM rk) AS candidate_count FROM rk ORDER BY score {way}, tile_id LIMIT {k}"""
_PAIR_RANKED = """SELECT row_number() OVER (ORDER BY score {way}, after_id) AS rank, round(score, 6) + 0.0 AS score, before_id AS before_tile_id, after_id AS after_tile_id, gap_days, sequence_id, label, latitude, longitude,
'/api/tiles/' || before_id || '/change/' || after_id || '/mndwi' AS change_map_url, (SELECT count(*) FROM rk) AS candidate_count FROM rk ORDER BY score {way}, after_id LIMIT {k}"""
_PAIRED = """nx AS (SELECT sequence_id, tile_id AS before_id, lead(tile_id) OVER w AS after_id, date_diff('day', CAST(ts AS DATE), CAST(lead(ts) OVER w AS DATE)) AS gap_days FROM sn WINDOW w AS (PARTITION BY sequence_id ORDER BY ts, tile_id)),
pr AS (SELECT * FROM nx WHERE gap_days BETWEEN 1 AND 30),
cm AS (SELECT before_id, after_id, a.ndwi - b.ndwi AS ndwi, a.mndwi - b.mndwi AS mndwi, a.ndvi - b.ndvi AS ndvi FROM pr JOIN maps b ON b.tile_id = before_id JOIN maps a ON a.tile_id = after_id AND a."row" = b."row")"""
_SHOWN = ["rank", "score", "tile_id", "sequence_id", "label", "latitude", "longitude", "preview_url", "candidate_count"]
_PAIR_SHOWN = ["rank", "score", "before_tile_id", "after_tile_id", "gap_days", "sequence_id", "label", "latitude", "longitude", "change_map_url", "candidate_count"]


def _hist(source: str, key: str, low: float, width: float) -> str:
    return base._hist(source, low, width).replace("group_id", key).replace("HAVING", "HAVING")


def _scene_maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scenes and their index maps; the maps are written once, as both ends of a pair and every look at them read them."""
    scenes, cells = scene_tables(spark, sf_dir)
    return scenes, materialize(spectral.index_maps(cells).select("tile_id", "row", *spectral.INDEX_BANDS), "scene-maps")


@said(f"""WITH {_SCENES}, rk AS (SELECT el.*, m.score FROM el JOIN (SELECT tile_id, median(mndwi) AS score FROM maps GROUP BY tile_id HAVING count(mndwi) > 0) m USING (tile_id)) {_RANKED.format(way="DESC", k=20)}""")
def evidence_water_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes inside dates and place by median MNDWI."""
    scenes, maps = _scene_maps(spark, sf_dir)
    found = evidence.spectral_evidence(request.Request(_ask("spectral_water_signal"), k=20), scenes, maps, "row", ring=_ring(spark))
    return rounded(evidence.scene_result(found.results, "median MNDWI").select(*_SHOWN))


_LIKENESS = """v AS (SELECT {key}, list(share ORDER BY pos) AS x, sqrt(sum(share * share)) AS n FROM d GROUP BY {key} HAVING sqrt(sum(share * share)) > 1e-12),
ok AS (SELECT {key} FROM {source} GROUP BY {key} HAVING count(mndwi) > 0), vo AS (SELECT v.* FROM v JOIN ok USING ({key}))"""


@said(f"""WITH {_SCENES}, {_hist("maps", "tile_id", -1.0, 0.0625)}, {_LIKENESS.format(key="tile_id", source="maps")},
ex AS (SELECT * FROM vo WHERE tile_id = (SELECT min(tile_id) FROM ok)), es AS (SELECT sequence_id FROM sn WHERE tile_id = (SELECT tile_id FROM ex)),
rk AS (SELECT el.*, round(least(1.0, list_dot_product(vo.x, ex.x) / (vo.n * ex.n)), 9) AS score FROM el JOIN vo USING (tile_id), ex WHERE el.tile_id <> ex.tile_id AND el.sequence_id <> (SELECT sequence_id FROM es)) {_RANKED.format(way="DESC", k=20)}""")
def evidence_scene_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes most like the first one with valid pixels; its own sequence is left out."""
    scenes, maps = _scene_maps(spark, sf_dir)
    example = maps.where("mndwi IS NOT NULL").agg(F.min("tile_id").alias("t")).first().t
    ask = request.Request(_ask("spectral_scene_similarity"), k=20, before_example_tile_id=example)
    found = evidence.spectral_evidence(ask, scenes, maps, "row", ring=_ring(spark), tie_places=9)
    return rounded(evidence.scene_result(found.results, "cosine").select(*_SHOWN))


_MEDIANS = """rk AS (SELECT pr.*, el.label, el.latitude, el.longitude, m.score FROM pr JOIN (SELECT before_id, after_id, median(mndwi) AS score FROM cm GROUP BY ALL HAVING count(mndwi) > 0) m USING (before_id, after_id) JOIN el ON el.tile_id = after_id)"""


def _water_change(spark: SparkSession, sf_dir: str, intent: str) -> DataFrame:
    scenes, maps = _scene_maps(spark, sf_dir)
    found = evidence.spectral_evidence(request.Request(_ask(intent), k=20), scenes, maps, "row", ring=_ring(spark))
    return rounded(evidence.pair_result(found.results, "median change of MNDWI").select(*_PAIR_SHOWN))


@said(f"WITH {_SCENES}, {_PAIRED}, {_MEDIANS} {_PAIR_RANKED.format(way='DESC', k=20)}")
def evidence_water_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of consecutive scenes by the median of their change maps, increases first."""
    return _water_change(spark, sf_dir, "spectral_water_increase")


@said(f"WITH {_SCENES}, {_PAIRED}, {_MEDIANS} {_PAIR_RANKED.format(way='ASC', k=20)}")
def evidence_water_decrease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _water_change(spark, sf_dir, "spectral_water_decrease")


@said(f"""WITH {_SCENES}, {_PAIRED}, cp AS (SELECT before_id || '>' || after_id AS pair, ndwi, mndwi, ndvi FROM cm), {_hist("cp", "pair", -2.0, 0.125)}, {_LIKENESS.format(key="pair", source="cp")},
ex AS (SELECT vo.*, pr.sequence_id FROM vo JOIN pr ON pair = before_id || '>' || after_id WHERE pair = (SELECT min(pair) FROM ok)),
rk AS (SELECT pr.*, el.label, el.latitude, el.longitude, round(greatest(-1.0, least(1.0, list_dot_product(vo.x, ex.x) / (vo.n * ex.n))), 9) AS score FROM pr JOIN vo ON vo.pair = before_id || '>' || after_id JOIN el ON el.tile_id = after_id, ex
  WHERE pr.sequence_id <> ex.sequence_id) {_PAIR_RANKED.format(way="DESC", k=20)}""")
def evidence_change_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose change histograms are most like those of the first pair with shared valid pixels."""
    scenes, maps = _scene_maps(spark, sf_dir)
    changes = spectral.change_maps(spectral.temporal_pairs(scenes, 30), maps, "row").where("mndwi IS NOT NULL")
    first = changes.agg(F.min(F.struct("before_id", "after_id")).alias("p")).first()
    if first is None or first.p is None:
        return rounded(_water_change(spark, sf_dir, "spectral_water_increase").limit(0))
    ask = request.Request(_ask("spectral_change_similarity"), k=20, before_example_tile_id=first.p.before_id, after_example_tile_id=first.p.after_id)
    found = evidence.spectral_evidence(ask, scenes, maps, "row", ring=_ring(spark), tie_places=9)
    return rounded(evidence.pair_result(found.results, "cosine of changes").select(*_PAIR_SHOWN))


_EMB = f"""sn AS (SELECT CAST(vec_id AS VARCHAR) AS tile_id, CAST(vec_id // 10 AS VARCHAR) AS sequence_id, CAST(DATE '1995-07-01' + CAST(vec_id % 2000 AS INT) AS TIMESTAMP) AS ts,
  [vec_id % 300 - 150, vec_id % 120 - 60, vec_id % 300 - 148, vec_id % 120 - 58]::DOUBLE[] AS bbox, CASE WHEN label % 2 = 0 THEN 'flood' ELSE 'no_flood' END AS label, (vec_id % 120 - 59)::DOUBLE AS latitude, (vec_id % 300 - 149)::DOUBLE AS longitude,
  CAST(embedding AS DOUBLE[]) AS e, vec_id FROM embeddings), {_PLACE},
el AS (SELECT * FROM sn WHERE vec_id % 5 <> 0 AND ts >= DATE '{START}' AND ts < DATE '{END + dt.timedelta(days=1)}' AND tile_id IN (SELECT tile_id FROM pl))"""


@said(f"""WITH {_EMB}, pv AS (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM sn WHERE vec_id % 5 = 0 AND label = 'flood'), pm AS (SELECT pos, avg(x) AS x FROM pv GROUP BY pos), q AS (SELECT list(x ORDER BY pos) AS v FROM pm),
rk AS (SELECT el.*, greatest(-1.0, least(1.0, list_cosine_similarity(e, v))) AS score FROM el, q) {_RANKED.format(way="DESC", k=10)}""")
def evidence_prototype_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes inside dates and place nearest to the flood prototype of separate support rows."""
    rows = embedding_scenes(spark, sf_dir)
    support = rows.where("vec_id % 5 = 0").select(F.get("labels", 0).alias("label"), "embedding")
    searchable = rows.where("vec_id % 5 <> 0")
    found = evidence.by_prototype(_ask("flood"), 10, searchable.select("tile_id", "embedding"), support, searchable.drop("embedding"), "s2_12band", _ring(spark))
    return rounded(evidence.scene_result(found.results, "cosine").select(*_SHOWN))


@said(f"""WITH {_EMB}, q AS (SELECT e AS v FROM sn WHERE tile_id = '7'), rk AS (SELECT el.*, greatest(-1.0, least(1.0, list_cosine_similarity(e, v))) AS score FROM el, q WHERE tile_id <> '7') {_RANKED.format(way="DESC", k=10)}""")
def evidence_example_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes nearest to an example tile, which alone is left out."""
    rows = embedding_scenes(spark, sf_dir).where("vec_id % 5 <> 0")
    found = evidence.by_example(_ask("visual_similarity"), 10, "7", rows.select("tile_id", "embedding"), rows.drop("embedding"), "rgb", _ring(spark))
    return rounded(evidence.scene_result(found.results, "cosine").select(*_SHOWN))


@said(f"WITH {_SCENES} SELECT tile_id, tile_id IN (SELECT tile_id FROM pl) AS inside FROM sn")
def polygon_box_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which scenes' boxes share a point with a polygon; boxes may cross the antimeridian."""
    scenes, _ = scene_tables(spark, sf_dir)
    west, south, east, north = (F.get("bbox", k) for k in range(4))
    inside = request.ring_meets_bounds(F.col("ring"), west, south, east, north)
    return scenes.crossJoin(F.broadcast(_ring(spark))).select("tile_id", F.coalesce(inside & F.col("bbox").isNotNull(), F.lit(False)).alias("inside"))


# Joins and checks ----------------------------------------------------------------------------------------------------

_SPLIT = base._SPLIT


@said(f"WITH {_SPLIT} SELECT tile_id, label FROM sp WHERE split = 'validation'")
def split_filter_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one split; rows and assignments must name the same ids."""
    rows = documents(spark, sf_dir)
    given = splits.stratified(rows, FRACTIONS, 17).select("tile_id", "split")
    return splits.rows_for_split(rows, given, "validation").select("tile_id", "label")


@said("SELECT CAST(vec_id AS VARCHAR) AS tile_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id % 2 = 0")
def gallery_record_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a gallery's ids; ids must be unique, known and those expected."""
    rows = gallery(spark, sf_dir)
    ids = rows.where("vec_id % 2 = 0").select("tile_id")
    return rounded(catalog.gallery_records(ids, rows.select("tile_id", "label"), ids))


@said("SELECT CAST(vec_id AS VARCHAR) AS tile_id, CASE WHEN vec_id % 5 = 0 THEN 'support' ELSE 'gallery' END AS side FROM embeddings")
def support_gallery_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support and searchable rows by id set: a semi and an anti join."""
    rows = gallery(spark, sf_dir)
    support = rows.where("vec_id % 5 = 0").select("tile_id")
    splits.require_known(support, rows, "tile_id", "support ids without a row")
    mine = rows.join(support, "tile_id", "left_semi").select("tile_id", F.lit("support").alias("side"))
    return mine.unionByName(rows.join(support, "tile_id", "left_anti").select("tile_id", F.lit("gallery").alias("side")))


@said("SELECT CAST(vec_id AS VARCHAR) AS tile_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, row_number() OVER (ORDER BY CAST(vec_id AS VARCHAR)) AS place FROM embeddings WHERE vec_id % 50 = 0")
def support_embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of given ids in order of id; an unknown id is an error."""
    rows = gallery(spark, sf_dir)
    found = catalog.lookup(rows.where("vec_id % 50 = 0").select("tile_id"), rows, "tile_id")
    placed = placed_within(found.select("tile_id", F.col("embedding")[0].cast("double").alias("first")), F.lit(0), F.col("tile_id"))
    return rounded(placed.select("tile_id", "first", "place"))


_RUNS = """u AS (SELECT 'run' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS run_id, CASE WHEN vec_id % 2 = 0 THEN 'cnn' ELSE 'vit' END AS architecture, CASE WHEN vec_id % 3 = 0 THEN 'rgb' ELSE 's2_12band' END AS modality, vec_id AS seed, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("run"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("run_id"), F.when(F.col("vec_id") % 2 == 0, "cnn").otherwise("vit").alias("architecture"),
        F.when(F.col("vec_id") % 3 == 0, "rgb").otherwise("s2_12band").alias("modality"), F.col("vec_id").alias("seed"), F.col("embedding")[0].cast("double").alias("score"),
    )


@said(f"""WITH {_RUNS}, f AS (SELECT architecture, modality, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS sd FROM u GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY architecture ORDER BY mean DESC, modality <> 'rgb', modality) AS nth FROM f),
c AS (SELECT u.*, row_number() OVER (PARTITION BY u.architecture ORDER BY abs(score - mean), seed) AS k FROM u JOIN b ON b.nth = 1 AND b.architecture = u.architecture AND b.modality = u.modality)
SELECT run_id, architecture, modality, seed, upper(architecture) || ' - ' || CASE WHEN modality = 'rgb' THEN 'RGB' ELSE '12-band' END AS display_name FROM c WHERE k = 1""")
def preset_run_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen run of each architecture among the available ones; a missing run is an error."""
    runs = _runs(spark, sf_dir)
    found = catalog.lookup(evaluation.family_presets(runs).select("run_id"), runs, "run_id")
    shown = F.concat(F.upper("architecture"), F.lit(" - "), F.when(F.col("modality") == "rgb", "RGB").otherwise("12-band"))
    return rounded(found.select("run_id", "architecture", "modality", "seed", shown.alias("display_name")))


@said(f"WITH {_SPLIT} SELECT group_id FROM sp WHERE split = 'train' INTERSECT SELECT group_id FROM sp WHERE split = 'validation'")
def field_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that training and validation share."""
    given = splits.stratified(documents(spark, sf_dir), FRACTIONS, 17)
    return given.where("split = 'train'").select("group_id").intersect(given.where("split = 'validation'").select("group_id"))


@said("SELECT CAST(label AS VARCHAR) AS category FROM embeddings UNION SELECT lang FROM documents")
def category_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of two tables of label lists."""
    one = gallery(spark, sf_dir).select(F.explode(F.array(F.col("label").cast("string"))).alias("category"))
    return one.union(documents(spark, sf_dir).select(F.explode(F.array("label")))).distinct()


@said("SELECT CAST(vec_id AS VARCHAR) AS tile_id FROM embeddings EXCEPT SELECT CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id % 5 = 0")
def gallery_without_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gallery(spark, sf_dir)
    return rows.select("tile_id").exceptAll(rows.where("vec_id % 5 = 0").select("tile_id"))


@said("""SELECT * FROM (VALUES ('cnn'), ('vit')) a(architecture), (VALUES ('rgb'), ('s2_12band')) m(modality), (SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS seed FROM nation)""")
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of an experiment: architectures by modalities by seeds, three short lists."""
    one = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    seeds = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("seed")).distinct()
    return one("architecture", "cnn", "vit").crossJoin(one("modality", "rgb", "s2_12band")).crossJoin(seeds)


@said("SELECT CAST(label AS BIGINT) AS label, CAST(min(vec_id) AS VARCHAR) AS tile_id FROM embeddings GROUP BY label")
def first_query_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.first_per_label(gallery(spark, sf_dir).select("label", "tile_id", F.col("vec_id").alias("nth")))
    return rounded(found.select("label", "tile_id"))


@said("SELECT c_name AS tile_id FROM customer ORDER BY c_name LIMIT 25")
def catalog_prefix_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tiles in order of path: what a trial run looks at."""
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("tile_id")).orderBy("tile_id").limit(25)


@said("""SELECT doc_id AS query_id, CAST(doc_id % 5 AS BIGINT) AS rank, lang AS tile_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pending_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows without a judgment: what a resumed run still has to do."""
    audit = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), (F.col("doc_id") % 5).alias("rank"), F.col("lang").alias("tile_id"))
    done = audit.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id")), "query_id", "left_semi")
    return rounded(readers.pending(audit, done).select("query_id", "rank", "tile_id"))


# Summaries -----------------------------------------------------------------------------------------------------------


@said("""WITH r AS (SELECT c_custkey AS k, CASE WHEN c_nationkey % 6 <> 0 THEN 'EPSG:' || (32600 + c_nationkey) END AS crs, CASE WHEN c_custkey % 8 <> 0 THEN c_acctbal / 200 END AS lat, c_acctbal / 100 AS lon,
  CASE WHEN c_custkey % 3 = 0 THEN 10.0 ELSE 20.0 END AS x, CASE WHEN c_custkey % 4 = 0 THEN 0 END AS nodata FROM customer),
c AS (SELECT coalesce(crs, 'missing') AS crs, count(*) AS n FROM r GROUP BY 1)
SELECT count(*) AS tile_count, count(*) FILTER (lat IS NULL) AS missing_coordinate_tiles, count(nodata) AS declared_nodata_tiles, round(min(lat), 6) AS latitude_min, round(max(lat), 6) AS latitude_max,
round(min(lon) FILTER (lat IS NOT NULL), 6) AS longitude_min, round(max(lon) FILTER (lat IS NOT NULL), 6) AS longitude_max, min(x) AS x_resolution_min, max(x) AS x_resolution_max, min(x) AS y_resolution_min, max(x) AS y_resolution_max,
(SELECT count(*) FROM c) AS distinct_crs_count, (SELECT string_agg(crs || ':' || n, ',' ORDER BY n DESC, crs) FROM c) AS crs_counts FROM r""")
def metadata_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    spacing = F.when(key % 3 == 0, 10.0).otherwise(20.0)
    rows = table(spark, sf_dir, "customer").select(
        key.alias("tile_id"), F.when(F.col("c_nationkey") % 6 != 0, F.concat(F.lit("EPSG:"), (F.col("c_nationkey") + 32600).cast("string"))).alias("crs"),
        F.when(key % 8 != 0, F.col("c_acctbal") / 200).alias("latitude"), (F.col("c_acctbal") / 100).alias("longitude"), spacing.alias("x_resolution"), spacing.alias("y_resolution"),
        F.when(key % 4 == 0, F.lit(0)).alias("nodata"),
    )
    return rounded(statistics.metadata_ranges(rows))


@said("SELECT l_returnflag AS band, count(*) AS pixels, round(avg(l_quantity), 6) AS mean, round(sqrt(greatest(var_pop(l_quantity), 1e-12)), 6) AS sd FROM lineitem GROUP BY 1")
def plain_band_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.plain_moments(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("band"), F.col("l_quantity").alias("value"))))


@said(f"SELECT count(*) AS categories, CAST(sum(paired_query_count) AS BIGINT) AS paired_query_count, round(avg(recall_delta), 5) AS macro_recall_delta, round(avg(map_delta), 5) AS macro_map_delta FROM ({SQL['paired_metric_delta']})")
def paired_delta_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.macro_deltas(rounded(evaluation.paired_deltas(*_delta_rows(spark, sf_dir))))
    return rounded(found.withColumns({c: F.round(c, 5) for c in ("macro_recall_delta", "macro_map_delta")}))


@said("""WITH j AS (SELECT doc_id % 20 AS q, toxic = 1 AS labelled, CASE WHEN quality = 0 THEN 'uncertain' WHEN doc_id % 3 = 0 THEN 'relevant' ELSE 'not_relevant' END AS d FROM labels),
b AS (SELECT q, count(*) AS n, count(*) FILTER (d = 'relevant') AS r, count(*) FILTER (d = 'uncertain') AS u FROM j GROUP BY q)
SELECT (SELECT count(*) FROM j) AS judged_count, count(*) AS query_count, CAST(sum(r) AS BIGINT) AS relevant, CAST(sum(u) AS BIGINT) AS uncertain, CAST(sum(n - r - u) AS BIGINT) AS not_relevant, round(avg(r / n), 6) AS macro_precision_lower,
round(avg((r + u) / n), 6) AS macro_precision_upper, (SELECT round(avg(CAST(labelled = (d = 'relevant') AS INT)), 6) FROM j WHERE d <> 'uncertain') AS agreement_on_definite, 100 AS expected_count,
CASE WHEN (SELECT count(*) FROM j) = 100 THEN 'complete' ELSE 'partial' END AS status FROM b""")
def judgment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro precision bounds, agreement over all definite judgments, and whether the audit is complete."""
    rows = table(spark, sf_dir, "labels").select(
        (F.col("doc_id") % 20).alias("query_id"), F.col("doc_id").alias("rank"), F.lit("toxic").alias("target_label"), F.when(F.col("toxic") == 1, "toxic,text").otherwise("text").alias("labels"),
        F.when(F.col("quality") == 0, "uncertain").when(F.col("doc_id") % 3 == 0, "relevant").otherwise("not_relevant").alias("judgment"),
    )
    return rounded(evaluation.judgment_summary(rows, 100))


@said("""SELECT count(*) FILTER (o_orderstatus <> 'P') AS available_scenes, count(*) AS catalog_scenes, strftime(min(o_orderdate) FILTER (o_orderstatus <> 'P'), '%Y-%m-%d') AS date_start,
strftime(max(o_orderdate) FILTER (o_orderstatus <> 'P'), '%Y-%m-%d') AS date_end FROM orders""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "P", "available").otherwise("missing").alias("asset_status"), F.col("o_orderdate").alias("timestamp"))
    return rounded(statistics.dataset_summary(rows))


@said(SQL["split_grouped"].replace("SELECT c_custkey AS tile_id, CAST(c_nationkey AS VARCHAR) AS group_id, split FROM customer", """SELECT split, count(*) AS records, count(*) FILTER (c_acctbal >= 0) AS available_scenes, count(*) FILTER (c_acctbal < 0) AS missing_scenes,
count(*) FILTER (c_custkey % 3 = 0) AS flood, count(*) FILTER (c_custkey % 3 <> 0) AS no_flood, count(DISTINCT c_nationkey) AS sequence_groups FROM customer""") + " GROUP BY split")
def split_availability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = splits.grouped(_customers(spark, sf_dir), FRACTIONS, 17)
    more = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tile_id"), F.when(F.col("c_acctbal") >= 0, "available").otherwise("missing").alias("asset_status"), (F.col("c_custkey") % 3 == 0).alias("flooding"))
    return rounded(splits.availability_summary(given.join(more, "tile_id")))


@said(f"""WITH {_RUNS}, s AS (SELECT architecture, modality, seed % 7 AS seed, seed % 5 AS label, avg(score) AS agreement FROM u GROUP BY ALL), p AS (SELECT architecture, modality, seed, avg(agreement) AS x FROM s GROUP BY ALL)
SELECT architecture, modality, count(*) AS seeds, round(avg(x), 6) + 0.0 AS mean, round(coalesce(stddev_samp(x), 0), 6) AS sd FROM p GROUP BY ALL""")
def cross_seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).groupBy("architecture", "modality", (F.col("seed") % 7).alias("seed"), (F.col("seed") % 5).alias("label")).agg(F.avg("score").alias("agreement"))
    return rounded(evaluation.cross_seed_summary(rows))


@said("SELECT CAST(date_part('day', ts) AS BIGINT) AS epoch, CAST(sum(user_id % 9) AS BIGINT) AS weight, round(CASE WHEN sum(user_id % 9) > 0 THEN sum(value * (user_id % 9)) / sum(user_id % 9) END, 6) AS loss FROM events GROUP BY 1")
def epoch_weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("epoch"), (F.col("user_id") % 9).alias("weight"), F.col("value").alias("loss"))
    return rounded(evaluation.epoch_means(rows, "loss"))


# Columns -------------------------------------------------------------------------------------------------------------


@said("""SELECT c_custkey AS id, split_part(c_name, '_', 1) AS field, 'part.' || (c_custkey % 5) AS stem, CASE WHEN c_custkey % 3 = 0 THEN '.tif' ELSE '.jpg' END AS suffix FROM customer""")
def filename_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What file names say: the field before the underscore, stem and suffix."""
    key = F.col("c_custkey")
    path = F.concat(F.lit("a/b.c/part."), (key % 5).cast("string"), F.when(key % 3 == 0, ".TIF").otherwise(".jpg"))
    return table(spark, sf_dir, "customer").select(key.alias("id"), names.field_of(F.col("c_name")).alias("field"), names.stem_of(path).alias("stem"), names.suffix_of(path).alias("suffix"))


@said("SELECT sha256(string_agg(doc_id || chr(0) || source || '/' || doc_id || chr(0) || n_chars || chr(0) || lang || chr(10), '' ORDER BY CAST(doc_id AS VARCHAR))) AS fingerprint FROM documents")
def gallery_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest over id, path, size and sorted labels of a gallery in order of id."""
    rows = documents(spark, sf_dir)
    labels = F.array_join(F.array_sort(F.array("label")), ",")
    nul = F.lit("\0")
    line = F.concat("tile_id", nul, F.concat_ws("/", "group_id", "tile_id"), nul, F.col("n_chars").cast("string"), nul, labels, F.lit("\n"))
    return ordered_digest(rows, line, F.col("tile_id"))


_SEED = " || ".join(f"substr(h, {2 * k + 1}, 2)" for k in range(7, -1, -1))


@said(f"WITH s AS (SELECT doc_id, v, sha256('17:3:' || doc_id || ':' || v) AS h FROM documents, (VALUES (0), (1)) t(v)) SELECT CAST(doc_id AS VARCHAR) AS tile_id, CAST(v AS BIGINT) AS view, CAST(CAST('0x' || {_SEED} AS UBIGINT) AS VARCHAR) AS seed FROM s")
def view_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("tile_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("view"))
    return rounded(rows.withColumn("seed", augment.view_seed(17, F.lit(3), F.col("tile_id"), F.col("view")).cast("string")))


@query
def view_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and flips of two views of each document; the generator is the standard library's, which SQL cannot say."""
    return augment.view_draws(documents(spark, sf_dir), 17, 3)


@query
def paired_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both views of all tiles of the grid, masks in lockstep."""
    return augment.paired_views(_grid(spark, sf_dir), 16, 17, 2, fixed_views=True).select("tile_id", "cell", "view", "row", "col", "valid")


@said("""SELECT event_id AS id, strftime(CASE WHEN event_id % 4 = 3 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) ELSE date_trunc('second', ts) END, '%Y-%m-%dT%H:%M:%SZ') AS time FROM events""")
def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times from ISO text with a Z, with an offset or without one, or else from a token of the day; as ISO text again."""
    key, ts = F.col("event_id") % 4, F.col("ts")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    later = F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(key == 0, F.concat(iso, F.lit("Z"))).when(key == 1, F.concat(later, F.lit("+02:00"))).when(key == 2, iso).otherwise("no time")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), catalog.iso_time(catalog.parsed_time(text, F.date_format(ts, "yyyy_MM_dd"))).alias("time"))


@said("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag FROM events")
def flag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id") % 4
    text = F.when(key == 0, " True ").when(key == 1, "FALSE").when(key == 2, "true")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), catalog.parsed_flag(text, "flag", False).alias("flag"))


@said(f"WITH {_SCENES} SELECT tile_id, (bbox[2] + bbox[4]) / 2 AS latitude, (bbox[1] + bbox[3]) / 2 AS longitude FROM sn")
def bbox_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    latitude, longitude = catalog.box_centre(F.col("bbox"))
    return scene_tables(spark, sf_dir)[0].select("tile_id", latitude.alias("latitude"), longitude.alias("longitude"))


@said("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested metadata read as a typed object and written again; text of another form is an error."""
    found = names.typed_json(F.col("props"), "struct<k:bigint>")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), found.alias("m")).select("id", F.col("m.k").alias("k"), F.to_json("m").alias("again"))


_XI1 = "xi - " + " - ".join(f"{b!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, b in enumerate(geo.BETA, 1))
_ETA1 = "eta - " + " - ".join(f"{b!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, b in enumerate(geo.BETA, 1))


@said(f"""WITH c AS (SELECT c_custkey AS id, 300000.0 + c_custkey % 400 * 1000 AS e, 4000000.0 + c_custkey % 1500 * 1000 AS n, 31 + c_custkey % 5 AS zone FROM customer),
x AS (SELECT id, zone, n / {geo.SCALE * geo.MERIDIAN!r} AS xi, (e - 500000.0) / {geo.SCALE * geo.MERIDIAN!r} AS eta FROM c), y AS (SELECT id, zone, {_XI1} AS xi, {_ETA1} AS eta FROM x), z AS (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM y)
SELECT id, round(degrees(chi + {" + ".join(f"{d!r} * sin({2 * k} * chi)" for k, d in enumerate(geo.DELTA, 1))}), 6) AS latitude, round(degrees(radians(zone * 6 - 183) + atan2(sinh(eta), cos(xi))), 6) AS longitude FROM z""")
def utm_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geographic centres of projected tiles."""
    key = F.col("c_custkey")
    latitude, longitude = geo.utm_to_wgs84(F.lit(300000.0) + key % 400 * 1000, F.lit(4000000.0) + key % 1500 * 1000, F.lit(31) + key % 5, F.lit(True))
    return rounded(table(spark, sf_dir, "customer").select(key.alias("id"), latitude.alias("latitude"), longitude.alias("longitude")))


# Rasters -------------------------------------------------------------------------------------------------------------


@said("""WITH v AS (SELECT l_suppkey AS t, unnest([l_quantity, l_tax * 100, l_discount * 100]) AS x FROM lineitem), e AS (SELECT t, quantile_cont(x, 0.02) AS lo, quantile_cont(x, 0.98) AS up FROM v GROUP BY t)
SELECT l_suppkey AS tile_id, l_orderkey AS k, l_linenumber AS n, round(greatest(0, least(1, (l_quantity - lo) / (up - lo))), 5) AS r, round(greatest(0, least(1, (l_tax * 100 - lo) / (up - lo))), 5) AS g, round(greatest(0, least(1, (l_discount * 100 - lo) / (up - lo))), 5) AS b
FROM lineitem JOIN e ON t = l_suppkey""")
def composite_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bands stretched jointly, so their relation stays."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tile_id"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("r"), (F.col("l_tax") * 100).alias("g"), (F.col("l_discount") * 100).alias("b"))
    return rounded(raster.composite(rows, ("r", "g", "b")).withColumns({c: F.round(c, 5) for c in "rgb"}))


_FINE = """pc AS (SELECT p_partkey // 64 AS tile_id, (p_partkey % 64) // 8 AS "row", p_partkey % 8 AS col, p_size % 11 <> 0 AS valid, CAST(p_size AS DOUBLE) AS value FROM part)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the pixels of eight by eight tiles."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(key / 64).alias("tile_id"), F.floor(key % 64 / 8).cast("int").alias("row"), (key % 8).cast("int").alias("col"), (F.col("p_size") % 11 != 0).alias("valid"), F.col("p_size").cast("double").alias("value")
    )


@said(f"""WITH {_FINE}, a AS (SELECT tile_id, "row" // 2 AS "row", col // 2 AS col, bool_and(valid) AS valid, avg(value) FILTER (valid) AS value FROM pc GROUP BY ALL), b AS (SELECT * FROM pc WHERE "row" < 4 AND col < 4),
v AS (SELECT tile_id, "row", col, coalesce(a.valid, false) AND coalesce(b.valid, false) AS valid, a.value AS x, b.value AS y FROM a FULL JOIN b USING (tile_id, "row", col))
SELECT tile_id, "row", col, valid, round(CASE WHEN valid THEN x ELSE 0 END, 6) AS fine, round(CASE WHEN valid THEN y ELSE 0 END, 6) AS plain FROM v""")
def bands_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 10 m band averaged onto a 20 m grid beside a 20 m band; a cell is valid if it is in both."""
    cells = _cells(spark, sf_dir)
    return rounded(raster.on_grid({"fine": (cells, 10.0), "plain": (cells.where("row < 4 AND col < 4"), 20.0)}, 20.0))


_AT = "greatest(0.0, least(({k} + 0.5) * 2 - 0.5, 7.0))"


@said(f"""WITH {_FINE}, t AS (SELECT DISTINCT tile_id FROM pc), o AS (SELECT tile_id, r.range AS "row", c.range AS col, {_AT.format(k="r.range")} AS y, {_AT.format(k="c.range")} AS x FROM t, range(4) r, range(4) c),
w AS (SELECT o.tile_id, o."row", o.col, pc.value * greatest(0, 1 - abs(y - pc."row")) * greatest(0, 1 - abs(x - pc.col)) AS v FROM o JOIN pc ON pc.tile_id = o.tile_id AND abs(y - pc."row") < 1 AND abs(x - pc.col) < 1)
SELECT tile_id, "row", col, round(sum(v) / 255, 6) AS value FROM w GROUP BY ALL""")
def resized_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles on a grid of half the size by bilinear interpolation, scaled to the unit range."""
    return rounded(raster.resized(_cells(spark, sf_dir), "value", 8, 4))


@said(f"""WITH {base._PIXELS}, v AS (SELECT tile_id, "row", group_id, b03, b04, b08, b11, row_number() OVER (PARTITION BY tile_id ORDER BY "row", group_id, b04) - 1 AS i, count(*) OVER (PARTITION BY tile_id) AS n FROM px WHERE valid)
SELECT tile_id, round(b03, 6) AS b03, round(b11, 6) AS b11 FROM v WHERE i = n // 2""")
def middle_valid_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel of each scene that is checked by hand."""
    rows = pixels(spark, sf_dir).select("tile_id", "row", F.struct("group_id", "b04").alias("col"), "valid", "b03", "b11")
    return rounded(statistics.middle_valid_pixels(rows).select("tile_id", "b03", "b11"))


@said(f"""WITH {_SCENES} SELECT tile_id, "row", round(greatest(0, least(1, (mndwi + 1) / 2)), 6) AS position FROM maps WHERE mndwi IS NOT NULL""")
def index_map_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each valid pixel of an index map lies on the scale that its picture shows."""
    _, maps = _scene_maps(spark, sf_dir)
    position = views.map_position(F.col("mndwi"), *views.INDEX_RANGE)
    return rounded(maps.where("mndwi IS NOT NULL").select("tile_id", "row", position.alias("position")))


# Artifacts -----------------------------------------------------------------------------------------------------------


@said("SELECT 'c:' || c_custkey AS tile_id, 'seg/' || c_custkey || '.tif' AS relative_path, c_mktsegment AS label FROM customer")
def catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog written, checked against its header and read back."""
    key = F.col("c_custkey").cast("string")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), key).alias("tile_id"), F.concat(F.lit("seg/"), key, F.lit(".tif")).alias("relative_path"), F.col("c_mktsegment").alias("label"))
    path, about = fresh_path(spark, "catalog"), {"dataset": "customers", "source_fingerprint": "x", "bands": list(catalog.BANDS), "expected_shape": [12, 64, 64]}
    catalog.write_catalog(rows, path, about)
    return catalog.read_catalog(spark, path, about)


@said("SELECT CAST(vec_id AS VARCHAR) AS tile_id, CAST(vec_id AS BIGINT) AS row, CASE WHEN vec_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM embeddings")
def artifact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings written as a checked artifact and read back: unique ids, unit lengths, rows without gaps, known splits."""
    rows = gallery(spark, sf_dir).select("tile_id", F.col("vec_id").alias("row"), F.when(F.col("vec_id") % 10 == 0, "test").otherwise("train").alias("split"), "embedding")
    path = fresh_path(spark, "artifact")
    catalog.write_embeddings(rows, path, model="none")
    return catalog.read_embeddings(spark, path).select("tile_id", "row", "split")


@said("SELECT 's' || n_nationkey AS stem, 'root/rgb/s' || n_nationkey || '.jpg' AS rgb, 'root/nir/s' || n_nationkey || '.jpg' AS nir, 'root/masks/s' || n_nationkey || '.png' AS masks FROM nation")
def stem_role_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several roles joined by stem; a stem without one of them is an error."""
    stem = F.concat(F.lit("s"), F.col("n_nationkey").cast("string"))
    each = F.explode(F.array(*[F.concat(F.lit(f"root/{r}/"), stem, F.lit(s)) for r, s in (("rgb", ".jpg"), ("nir", ".jpg"), ("masks", ".png"), ("other", ".txt"))]))
    return catalog.stem_roles(table(spark, sf_dir, "nation").select(each.alias("path")), ("rgb", "nir", "masks"))


@said("""SELECT 'scene:' || o_orderkey || ':1996_01_0' || (o_orderkey % 7 + 1) AS tile_id, o_orderkey % 2 = 0 AS flooding, strftime(CASE WHEN o_orderkey % 3 = 0 THEN CAST(make_date(1996, 1, CAST(o_orderkey % 7 + 1 AS INT)) AS TIMESTAMP) ELSE o_orderdate END, '%Y-%m-%dT%H:%M:%SZ') AS time,
CASE WHEN o_orderkey % 5 = 0 THEN 'B11' ELSE '' END AS missing, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' ELSE 'available' END AS asset_status FROM orders""")
def scene_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and label items paired one to one, flags and times parsed, assets resolved against a file listing."""
    key = F.col("o_orderkey")
    token = F.concat(F.lit("1996_01_0"), (key % 7 + 1).cast("string"))
    orders = table(spark, sf_dir, "orders").select("*", key.cast("string").alias("sequence_id"), token.alias("date"), F.concat(F.lit("s/"), key.cast("string")).alias("folder"))
    asset = lambda b: F.struct(F.lit(f"{b}.tif").alias("href"), F.lit(b).alias("title"))
    bands = ("B03", "B11")
    iso = F.when(key % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("unknown")
    sources = orders.select(F.col("sequence_id").alias("id"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("bbox"), F.create_map(F.lit("datetime"), iso).alias("properties"), F.create_map(*[x for b in bands for x in (F.lit(b), asset(b))]).alias("assets"), "folder", "sequence_id", "date")
    labels = orders.select("sequence_id", "date", F.create_map(F.lit("FLOODING"), F.when(key % 2 == 0, "True").otherwise("false")).alias("properties"))
    files = orders.select(F.explode(F.filter(F.array(*[F.struct((F.lit(b == "B03") | (key % 5 != 0)).alias("there"), F.concat("folder", F.lit(f"/{b}.tif")).alias("path")) for b in bands]), lambda x: x["there"])).alias("x")).select("x.path")
    found = catalog.scene_catalog(sources, labels, files, bands)
    return found.select("tile_id", "flooding", catalog.iso_time(F.col("timestamp")).alias("time"), F.array_join("missing_bands", ",").alias("missing"), "asset_status")


@said(f"WITH {base._knn(10)}, c AS (SELECT query_id, rank, r.tile_id, printf('%.7f', score) AS score, CAST(g0.label AS VARCHAR) || ',all' AS labels FROM r JOIN g0 ON g0.tile_id = r.tile_id WHERE rank <= 5) SELECT query_id, 'query ' || query_id AS query_text, q0.label::VARCHAR AS target_label, rank, c.tile_id, round(floor(CAST(score AS DOUBLE) * 100000) / 100000, 6) AS score, labels FROM c JOIN g0 q0 ON q0.tile_id = query_id WHERE q0.vec_id % 20 = 0")
def audit_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of an audit gets: the first five results of canonical queries."""
    rows = gallery(spark, sf_dir)
    asked = rows.where("vec_id % 10 = 0").select(F.col("tile_id").alias("query_id"), F.concat(F.lit("query "), "tile_id").alias("query_text"), F.col("label").cast("string").alias("target_label"), (F.col("vec_id") % 20 == 0).alias("canonical"))
    labels = rows.select("tile_id", F.array(F.col("label").cast("string"), F.lit("all")).alias("labels"))
    found = sinks.audit_rows(_top(spark, sf_dir, 10), asked, labels)
    return rounded(found.withColumn("score", F.floor(F.col("score").cast("double") * 100000) / 100000))  # cut, not rounded: the text has seven places


@said("SELECT l_returnflag AS band, count(*) AS pixels, round(avg(l_tax), 6) AS mean, round(sqrt(greatest(var_pop(l_tax), 1e-12)), 6) AS sd, true AS reused FROM lineitem GROUP BY 1")
def cached_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics built under a manifest, then found again; another manifest would build them anew."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("band"), F.col("l_tax").alias("value"))
    path, about = fresh_path(spark, "statistics"), {"fingerprint": "x", "bands": ["A", "N", "R"]}
    for _ in range(2):
        found, reused = catalog.reuse_or_build(spark, path, about, lambda: statistics.plain_moments(rows))
    return rounded(found.withColumn("reused", F.lit(reused)))


@said(f"""WITH {base._knn(7, g="SELECT * FROM g0 WHERE vec_id % 10 <> 0", q="SELECT tile_id AS query_id, label AS ql, e FROM g0 WHERE vec_id = 0", skip=False)} {base._KNN_OUT}""")
def search_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search run: the first validation tile against the training gallery, no deeper than it is."""
    rows = gallery(spark, sf_dir).select("tile_id", F.col("vec_id").alias("row"), "embedding", F.when(F.col("vec_id") % 10 == 0, "validation").otherwise("train").alias("split"))
    asked, train, k = evaluation.neighbour_queries(rows, None, 7)
    return rounded(search.top_k(train, asked, k, skip_self=False))


_PRECISION = f"""WITH g0 AS ({base._G}), a AS (SELECT *, v.m FROM g0, (VALUES ('rgb', 16), ('s2_12band', 64)) v(m, d), (VALUES (0), (1), (2)) s(seed)),
pv AS (SELECT m, seed, label, unnest(e[1:d]) AS x, generate_subscripts(e[1:d], 1) AS pos FROM a WHERE vec_id % 5 = seed), pm AS (SELECT m, seed, label, pos, avg(x) AS x FROM pv GROUP BY ALL),
q AS (SELECT m, seed, label, list(x ORDER BY pos) AS v FROM pm GROUP BY ALL),
s AS (SELECT q.m, q.seed, q.label, a.tile_id, a.label = q.label AS hit, row_number() OVER (PARTITION BY q.m, q.seed, q.label ORDER BY list_cosine_similarity(a.e[1:a.d], v) DESC, a.tile_id) AS rank FROM q JOIN a ON a.m = q.m AND a.seed = q.seed AND a.vec_id % 5 <> a.seed),
c AS (SELECT m, seed, label, avg(CAST(hit AS INT)) AS p FROM s WHERE rank <= 5 GROUP BY ALL), r AS (SELECT m, seed, avg(p) AS score FROM c GROUP BY ALL), f AS (SELECT m, avg(score) AS mean, stddev_samp(score) AS sd FROM r GROUP BY m),
b AS (SELECT * FROM f ORDER BY mean DESC, m <> 'rgb' LIMIT 1)"""


@said(f"{_PRECISION} SELECT 'cnn' AS architecture, b.m AS modality, 'cnn/' || b.m || '/' || seed AS run_id, CAST(seed AS BIGINT) AS seed, round(mean, 6) AS mean, round(sd, 6) AS sd FROM r JOIN b ON b.m = r.m ORDER BY abs(score - mean), seed LIMIT 1")
def prototype_model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro precision of prototypes for each run, then the preset across runs: two modalities by three seeds."""
    rows, scores = gallery(spark, sf_dir), None
    for modality, wide in (("rgb", 16), ("s2_12band", 64)):
        tiles = rows.withColumn("embedding", F.slice("embedding", 1, wide))
        for seed in range(3):
            made = search.prototypes(tiles.where(F.col("vec_id") % 5 == seed)).select(F.col("label").cast("string").alias("query_id"), "embedding")
            hits = search.top_k(tiles.where(F.col("vec_id") % 5 != seed), made, 5, skip_self=False).join(rows.select("tile_id", "label"), "tile_id")
            per = hits.groupBy("query_id").agg(F.avg((F.col("label").cast("string") == F.col("query_id")).cast("double")).alias("p"))
            one = per.agg(F.avg("p").alias("score")).select(F.lit(f"cnn/{modality}/{seed}").alias("run_id"), F.lit("cnn").alias("architecture"), F.lit(modality).alias("modality"), F.lit(seed).alias("seed"), "score")
            scores = one if scores is None else scores.unionByName(one)
    return rounded(evaluation.family_presets(scores))


def _encoder(bands: int, seed: int = 3) -> encoders.Convolutional:
    """A small encoder with drawn weights."""
    rng, weights, before = np.random.default_rng(seed), {"mean": np.zeros(bands), "deviation": np.ones(bands)}, bands
    for k in range(3):
        weights |= {f"kernel_{k}": rng.normal(size=(16, before, 3, 3)) / 3, f"scale_{k}": np.ones(16), f"shift_{k}": np.zeros(16)}
        before = 16
    return encoders.Convolutional(weights | {"project": rng.normal(size=(16, 16)), "offset": np.zeros(16)})


@query
def corpus_embedding_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one-band 8 by 8 tiles through an encoder, written as an artifact with provenance and read back; its numbers are tested against plain loops."""
    rows = gallery(spark, sf_dir)
    given = splits.stratified(rows.select("tile_id", F.col("label").cast("string").alias("label")), FRACTIONS, 17)
    made = encoders.embed_corpus(rows.select("tile_id", F.col("embedding").alias("values")), given, _encoder(1), (1, 8, 8), fresh_path(spark, "encoded"), fingerprint="x")
    return made.select("tile_id", "split", F.col("embedding")[0].cast("double").alias("first"))

