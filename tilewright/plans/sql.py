"""DuckDB SQL that says what the registered queries return; written from their definitions."""

from __future__ import annotations

_G = "SELECT CAST(vec_id AS VARCHAR) AS tile_id, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
_SCORE = {
    "cosine": ("greatest(-1.0, least(1.0, list_cosine_similarity(q.e, g.e)))", "DESC"),
    "inner_product": ("list_dot_product(q.e, g.e)", "DESC"),
    "euclidean": ("list_distance(q.e, g.e)", "ASC"),
}


def _knn(k: int, metric: str = "cosine", g: str = "SELECT * FROM g0", q: str = "SELECT tile_id AS query_id, label AS ql, e FROM g0 WHERE vec_id % 10 = 0", base: str = _G, skip: bool = True, name: str = "r") -> str:
    """Common tables ``g0`` and ``r(query_id, rank, tile_id, score)``."""
    score, way = _SCORE[metric]
    return f"""g0 AS ({base}), g AS ({g}), q AS ({q}),
s AS (SELECT query_id, g.tile_id, {score} AS score FROM q, g {"WHERE query_id <> g.tile_id" if skip else ""}),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {way}, tile_id) AS rank FROM s),
{name} AS (SELECT query_id, rank, tile_id, score FROM n WHERE rank <= {k})"""


_KNN_OUT = "SELECT query_id, rank, tile_id, round(score, 6) AS score FROM r"


def _metrics(ranked: str, relevance: str, totals: str, k: int, name: str = "m") -> str:
    """``ranked(query_id, category, rank, tile_id)`` and the rest as table names; gives ``m``."""
    return f"""h_{name} AS (SELECT a.*, CASE WHEN b.tile_id IS NULL THEN 0 ELSE 1 END AS hit FROM {ranked} a LEFT JOIN {relevance} b ON a.tile_id = b.tile_id AND a.category = b.category),
c_{name} AS (SELECT *, sum(hit) OVER (PARTITION BY category, query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS so_far FROM h_{name}),
p_{name} AS (SELECT category, query_id, sum(hit) AS hits, sum(CASE WHEN hit = 1 THEN so_far / rank ELSE 0 END) AS ps FROM c_{name} GROUP BY ALL),
{name} AS (SELECT p.category, query_id, coalesce(relevant, 0) AS relevant, CAST(hits AS BIGINT) AS hits, hits / {k}.0 AS precision_at_k,
  CASE WHEN coalesce(relevant, 0) > 0 THEN hits / relevant ELSE 0.0 END AS recall_at_k,
  CASE WHEN coalesce(relevant, 0) > 0 THEN ps / least({k}, relevant) ELSE 0.0 END AS ap_at_k
  FROM p_{name} p LEFT JOIN {totals} t ON p.category = t.category)"""


_CATEGORY = """k AS (SELECT category, count(*) AS queries, avg(precision_at_k) AS precision_at_k, avg(recall_at_k) AS recall_at_k, avg(ap_at_k) AS map_at_k
  FROM m WHERE relevant > 0 GROUP BY category)"""
_CATEGORY_OUT = "SELECT category, queries, round(precision_at_k, 6) AS precision_at_k, round(recall_at_k, 6) AS recall_at_k, round(map_at_k, 6) AS map_at_k FROM k"
_MACRO_OUT = "SELECT count(*) AS categories, round(avg(precision_at_k), 6) AS precision_at_k, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(map_at_k), 6) AS map_at_k FROM k"
_OWN = """rel AS (SELECT tile_id, CAST(label AS BIGINT) AS category FROM g0), tot AS (SELECT category, count(*) - 1 AS relevant FROM rel GROUP BY category),
want AS (SELECT query_id, CAST(ql AS BIGINT) AS category FROM q)"""
_PATTERN = f"WITH {_knn(10)}, {_OWN}, rk AS (SELECT r.*, category FROM r JOIN want USING (query_id)), {_metrics('rk', 'rel', 'tot', 10)}, {_CATEGORY} "
_PROMPTS = (
    "WITH "
    + _knn(10, q="SELECT tile_id AS query_id, (vec_id // 10) % 12 AS category, e FROM g0 WHERE vec_id % 10 = 0", skip=False)
    + """, rel AS (SELECT tile_id, CAST(label AS BIGINT) AS category FROM g0), tot AS (SELECT category, count(*) AS relevant FROM rel GROUP BY category),
rk AS (SELECT r.*, category FROM r JOIN q USING (query_id)), """
    + _metrics("rk", "rel", "tot", 10)
)
_PROTO = f"""g0 AS ({_G}), pv AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos FROM g0 WHERE vec_id % 5 = 0),
pm AS (SELECT label, pos, avg(x) AS x FROM pv GROUP BY ALL), pn AS (SELECT label, sqrt(sum(x * x)) AS n FROM pm GROUP BY label),
pp AS (SELECT label, pos, x / n AS value FROM pm JOIN pn USING (label))"""
_PROTO_HITS = f"""{_PROTO}, q AS (SELECT CAST(label AS VARCHAR) AS query_id, list(value ORDER BY pos) AS e FROM pp GROUP BY label),
s AS (SELECT query_id, tile_id, g0.label, greatest(-1.0, least(1.0, list_cosine_similarity(q.e, g0.e))) AS score FROM q, g0 WHERE vec_id % 5 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tile_id) AS rank FROM s), r AS (SELECT * FROM n WHERE rank <= 10)"""

_PIXELS = """px AS (SELECT l_orderkey AS tile_id, l_suppkey AS group_id, CAST(l_linenumber AS BIGINT) AS "row", l_returnflag <> 'R' AS valid,
  l_quantity AS b03, l_extendedprice / 1000 AS b04, l_tax * 100 AS b08, l_discount * 100 AS b11 FROM lineitem),
maps AS (SELECT *, CASE WHEN valid AND abs(b03 + b08) > 1e-6 THEN (b03 - b08) / (b03 + b08) END AS ndwi,
  CASE WHEN valid AND abs(b03 + b11) > 1e-6 THEN (b03 - b11) / (b03 + b11) END AS mndwi,
  CASE WHEN valid AND abs(b08 + b04) > 1e-6 THEN (b08 - b04) / (b08 + b04) END AS ndvi FROM px)"""


def _long(source: str, key: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{n}' AS index_name, {k} AS nth, {n} AS value FROM {source}" for k, n in enumerate(("ndwi", "mndwi", "ndvi")))


def _hist(source: str, low: float, width: float) -> str:
    """``d(group_id, pos, share)`` for 32 bins of three indices."""
    return f"""lv AS ({_long(source, "group_id")}),
b0 AS (SELECT group_id, nth, value, least(31, CAST(floor((value - ({low})) / {width}) AS BIGINT)) AS b FROM lv WHERE value >= {low} AND value <= {-low}),
b1 AS (SELECT group_id, nth, CASE WHEN value < {low} + b * {width} THEN b - 1 WHEN b < 31 AND value >= {low} + (b + 1) * {width} THEN b + 1 ELSE b END AS b FROM b0),
hc AS (SELECT group_id, nth, b, count(*) AS n FROM b1 GROUP BY ALL), ht AS (SELECT group_id, nth, sum(n) AS t FROM hc GROUP BY ALL),
grid AS (SELECT group_id, nth, b FROM (SELECT DISTINCT group_id FROM {source}), (SELECT unnest(range(3)) AS nth), (SELECT unnest(range(32)) AS b)),
d AS (SELECT grid.group_id, grid.nth * 32 + grid.b AS pos, coalesce(n, 0) / coalesce(t, 1) AS share FROM grid LEFT JOIN hc ON hc.group_id = grid.group_id AND hc.nth = grid.nth AND hc.b = grid.b LEFT JOIN ht ON ht.group_id = grid.group_id AND ht.nth = grid.nth)"""


_LIKE = """v AS (SELECT group_id, list(share ORDER BY pos) AS x, sqrt(sum(share * share)) AS n FROM d GROUP BY group_id HAVING sqrt(sum(share * share)) > 1e-12),
sc AS (SELECT v.group_id, round(least(1.0, list_dot_product(v.x, o.x) / (v.n * o.n)), 9) AS score FROM v, v o WHERE o.group_id = 1 AND v.group_id <> 1)
SELECT group_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, group_id) AS rank, (SELECT count(*) FROM sc) AS candidate_count FROM sc ORDER BY score DESC, group_id LIMIT 10"""
_DELTAS = """dl AS (SELECT group_id, ndwi - lag(ndwi) OVER w AS ndwi, mndwi - lag(mndwi) OVER w AS mndwi, ndvi - lag(ndvi) OVER w AS ndvi FROM maps WINDOW w AS (PARTITION BY tile_id ORDER BY "row", group_id, b04, b03))"""
_PAIRS = """sc AS (SELECT lpad(CAST(event_id AS VARCHAR), 9, '0') AS tile_id, CAST(user_id AS VARCHAR) AS sequence_id, ts, value FROM events),
nx AS (SELECT sequence_id, tile_id AS before_id, lead(tile_id) OVER w AS after_id, date_diff('day', CAST(ts AS DATE), CAST(lead(ts) OVER w AS DATE)) AS gap_days,
  value AS v0, lead(value) OVER w AS v1, lead(ts) OVER w AS t1 FROM sc WINDOW w AS (PARTITION BY sequence_id ORDER BY ts, tile_id)),
pr AS (SELECT * FROM nx WHERE gap_days > 0 AND gap_days <= 30)"""


def _change(way: str) -> str:
    return f"""WITH {_PAIRS}, ch AS (SELECT before_id, after_id, gap_days, v1 - v0 AS score FROM pr WHERE t1 >= DATE '2024-01-05' AND t1 < DATE '2024-01-26')
SELECT before_id, after_id, gap_days, round(score, 6) AS score, row_number() OVER (ORDER BY score {way}, after_id) AS rank, (SELECT count(*) FROM ch) AS candidate_count
FROM ch ORDER BY score {way}, after_id LIMIT 20"""


def _sorted(name: str, key: str) -> str:
    return f"sha256('17:' || CAST({name} AS VARCHAR)), {key}"


_DOCS = "dc AS (SELECT CAST(doc_id AS VARCHAR) AS tile_id, lang AS label, source AS group_id, n_chars FROM documents)"
_SPLIT = f"""{_DOCS}, o AS (SELECT *, row_number() OVER (PARTITION BY coalesce(label, '__all__') ORDER BY {_sorted("tile_id", "tile_id")}) AS place, count(*) OVER (PARTITION BY coalesce(label, '__all__')) AS n FROM dc),
sp AS (SELECT tile_id, label, group_id, CASE WHEN place <= round_even(n * 0.8, 0) THEN 'train' WHEN place <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'validation' ELSE 'test' END AS split FROM o)"""
_GRID = """gr AS (SELECT l_suppkey AS tile_id, CAST(floor((l_orderkey * 8 + l_linenumber) / 16) AS BIGINT) % 16 AS "row", (l_orderkey * 8 + l_linenumber) % 16 AS col,
  l_returnflag <> 'R' AS valid, l_extendedprice AS value, l_orderkey * 8 + l_linenumber AS cell FROM lineitem)"""
_PLACES = """pl AS (SELECT 'r:' || r_regionkey AS place_id, 'country' AS level, r_name AS name, r_name AS country, ['REGION ' || r_regionkey] AS aliases FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'admin1', n_name, r_name, ['N' || n_nationkey] FROM nation JOIN region ON n_regionkey = r_regionkey),
nm AS (SELECT *, list_transform(list_prepend(name, aliases), lambda x: trim(lower(x))) AS names FROM pl)"""
_D4 = {
    0: ('"row"', "col"), 1: ("15 - col", '"row"'), 2: ('15 - "row"', "15 - col"), 3: ("col", '15 - "row"'),
}
_MEASURES = ", ".join(
    f"count({n}) AS {n}_valid, median({n}) AS {n}_median, min({n}) AS {n}_min, max({n}) AS {n}_max, count(*) FILTER (abs({n}) > 1.00001) AS {n}_outside" for n in ("ndwi", "mndwi", "ndvi")
)
_SCENES = f"""{_PIXELS}, sm AS (SELECT tile_id, count(*) FILTER (valid) AS valid_pixels, count(*) AS total_pixels, avg(CAST(valid AS INT)) AS valid_fraction,
  avg(CASE WHEN valid THEN CAST(b08 = 0 AND b11 = 0 AS INT) END) AS all_zero_fraction, {_MEASURES} FROM maps GROUP BY tile_id)"""

SQL: dict[str, str] = {
    "knn_cosine_topk": f"WITH {_knn(10)} {_KNN_OUT}",
    "knn_inner_product_topk": f"WITH {_knn(10, 'inner_product')} {_KNN_OUT}",
    "knn_euclidean_topk": f"WITH {_knn(10, 'euclidean')} {_KNN_OUT}",
    "knn_unnormalised_ip_vs_cosine": f"""WITH g0 AS (SELECT CAST(vec_id AS VARCHAR) AS tile_id, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1.0 + vec_id % 5)) AS e FROM embeddings),
s AS (SELECT q.tile_id AS query_id, g.tile_id, list_dot_product(q.e, g.e) AS ip, greatest(-1.0, least(1.0, list_cosine_similarity(q.e, g.e))) AS c FROM g0 q, g0 g WHERE q.vec_id % 10 = 0 AND q.tile_id <> g.tile_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ip DESC, tile_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, tile_id) AS b FROM s)
SELECT query_id, max(tile_id) FILTER (a = 1) AS ip_id, round(max(ip) FILTER (a = 1), 6) AS ip, max(tile_id) FILTER (b = 1) AS cosine_id, round(max(c) FILTER (b = 1), 6) AS cosine FROM n GROUP BY query_id""",
    "knn_filtered_by_label_and_range": f"WITH {_knn(5, g='SELECT * FROM g0 WHERE label IN (1, 3, 5) AND vec_id BETWEEN 50 AND 400')} {_KNN_OUT}",
    "knn_neighbor_export": f"WITH {_knn(3)} SELECT query_id, CAST(a.label AS BIGINT) AS query_label, rank, r.tile_id, CAST(b.label AS BIGINT) AS neighbour_label, round(round(score, 8), 6) AS score FROM r JOIN g0 a ON a.tile_id = query_id JOIN g0 b ON b.tile_id = r.tile_id",
    "knn_label_agreement": f"""WITH {_knn(10)}, x AS (SELECT r.query_id, CAST(ql AS BIGINT) AS label, rank, CAST(g0.label = ql AS INT) AS hit FROM r JOIN g0 ON g0.tile_id = r.tile_id JOIN q ON q.query_id = r.query_id),
y AS (SELECT query_id, label, k, avg(hit) AS a FROM x, (VALUES (1), (5), (10)) t(k) WHERE rank <= k GROUP BY ALL)
SELECT label, CAST(k AS BIGINT) AS k, count(*) AS queries, round(avg(a), 6) AS agreement FROM y GROUP BY GROUPING SETS ((label, k), (k))""",
    "pattern_retrieval_metrics": _PATTERN + _CATEGORY_OUT,
    "pattern_retrieval_macro_min_support": _PATTERN + _MACRO_OUT + " WHERE queries >= 5",
    "text_retrieval_metrics": _PROMPTS + " SELECT category, query_id, relevant, hits, round(precision_at_k, 6) AS precision_at_k, round(recall_at_k, 6) AS recall_at_k, round(ap_at_k, 6) AS ap_at_k FROM m",
    "text_retrieval_macro": f"{_PROMPTS}, {_CATEGORY} {_MACRO_OUT}",
    "multilabel_retrieval_metrics": f"""WITH {_knn(10)}, rel AS (SELECT tile_id, CAST(label AS VARCHAR) AS category FROM g0 UNION ALL SELECT tile_id, 'third' FROM g0 WHERE vec_id % 3 = 0),
tot AS (SELECT category, count(*) - 1 AS relevant FROM rel GROUP BY category), rk AS (SELECT r.*, category FROM r JOIN rel ON rel.tile_id = query_id), {_metrics("rk", "rel", "tot", 10)}, {_CATEGORY} {_CATEGORY_OUT}""",
    "class_prototypes": f"WITH {_PROTO} SELECT CAST(label AS BIGINT) AS label, CAST(pos AS BIGINT) AS pos, round(value, 6) AS value FROM pp",
    "prototype_topk": f"WITH {_PROTO_HITS} {_KNN_OUT}",
    "prototype_precision_at_k": f"WITH {_PROTO_HITS} SELECT query_id, round(avg(CAST(CAST(label AS VARCHAR) = query_id AS INT)), 6) AS precision_at_k FROM r GROUP BY query_id",
    "family_preset_selection": """WITH u AS (SELECT 'run' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS run_id, CASE WHEN vec_id % 2 = 0 THEN 'cnn' ELSE 'vit' END AS architecture,
  CASE WHEN vec_id % 3 = 0 THEN 'rgb' ELSE 's2_12band' END AS modality, vec_id AS seed, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings),
f AS (SELECT architecture, modality, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS sd FROM u GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY architecture ORDER BY mean DESC, modality <> 'rgb', modality) AS nth FROM f),
c AS (SELECT u.*, b.mean, b.sd, row_number() OVER (PARTITION BY u.architecture ORDER BY abs(score - mean), seed) AS k FROM u JOIN b ON b.nth = 1 AND b.architecture = u.architecture AND b.modality = u.modality)
SELECT architecture, modality, run_id, seed, round(mean, 6) AS mean, round(sd, 6) AS sd FROM c WHERE k = 1""",
    "paired_metric_delta": f"""WITH {_knn(10)}, {_OWN}, rk AS (SELECT r.*, category FROM r JOIN want USING (query_id)), {_metrics("rk", "rel", "tot", 10)},
s2 AS (SELECT q.query_id, g.tile_id, list_cosine_similarity(q.e[1:32], g.e[1:32]) AS score FROM q, g WHERE query_id <> g.tile_id),
n2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tile_id) AS rank FROM s2), rk2 AS (SELECT n2.*, category FROM n2 JOIN want USING (query_id) WHERE rank <= 10), {_metrics("rk2", "rel", "tot", 10, "m2")}
SELECT category, count(*) AS paired_query_count, round(avg(m.recall_at_k - m2.recall_at_k), 6) AS recall_delta, round(avg(m.ap_at_k - m2.ap_at_k), 6) AS map_delta FROM m JOIN m2 USING (category, query_id) GROUP BY category""",
    "spectral_index_values": f'WITH {_PIXELS} SELECT tile_id, "row", round(ndwi, 6) AS ndwi, round(mndwi, 6) AS mndwi, round(ndvi, 6) AS ndvi FROM maps',
    "spectral_scene_summary": f"""WITH {_PIXELS}, lv AS ({_long("maps", "tile_id")}) SELECT tile_id, index_name, count(value) AS valid_pixels, round(coalesce(avg(value), 0), 6) AS mean, round(coalesce(median(value), 0), 6) AS median,
round(coalesce(avg(CAST(value > 0 AS INT)), 0), 6) AS positive_fraction FROM lv GROUP BY ALL""",
    "spectral_histogram": f"WITH {_PIXELS}, {_hist('maps', -1.0, 0.0625)} SELECT group_id, pos, round(share, 6) AS share FROM d",
    "spectral_histogram_similarity": f"WITH {_PIXELS}, {_hist('maps', -1.0, 0.0625)}, {_LIKE}",
    "water_signal_rank": f"""WITH {_PIXELS}, w AS (SELECT tile_id, median(mndwi) AS score, count(mndwi) AS valid_pixels FROM maps GROUP BY tile_id HAVING count(mndwi) > 0)
SELECT tile_id, round(score, 6) AS score, valid_pixels, row_number() OVER (ORDER BY score DESC, tile_id) AS rank, (SELECT count(*) FROM w) AS candidate_count FROM w ORDER BY score DESC, tile_id LIMIT 20""",
    "temporal_pairs": f"WITH {_PAIRS} SELECT sequence_id, before_id, after_id, gap_days FROM pr",
    "temporal_change_increase": _change("DESC"),
    "temporal_change_decrease": _change("ASC"),
    "change_histogram_similarity": f"WITH {_PIXELS}, {_DELTAS}, {_hist('dl', -2.0, 0.125)}, {_LIKE}",
    "split_stratified": f"WITH {_SPLIT} SELECT tile_id, label, split FROM sp",
    "split_grouped": """WITH RECURSIVE gs AS (SELECT CAST(c_nationkey AS VARCHAR) AS group_id, count(*) AS n FROM customer GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, sha256('17:' || group_id)) AS i, sum(n) OVER () AS t, count(*) OVER () AS k FROM gs),
f(i, c0, c1, c2, split) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS HUGEINT), CAST(0 AS HUGEINT), '' UNION ALL
  SELECT i, c0 + CASE WHEN pick = 0 THEN n ELSE 0 END, c1 + CASE WHEN pick = 1 THEN n ELSE 0 END, c2 + CASE WHEN pick = 2 THEN n ELSE 0 END, ['train', 'validation', 'test'][pick + 1]
  FROM (SELECT i, n, c0, c1, c2, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS pick FROM (
    SELECT o.i, n, c0, c1, c2, CASE WHEN must AND c0 > 0 THEN -1e300 ELSE CAST(t AS DOUBLE) * 0.8 - c0 END AS l0, CASE WHEN must AND c1 > 0 THEN -1e300 ELSE CAST(t AS DOUBLE) * 0.1 - c1 END AS l1,
      CASE WHEN must AND c2 > 0 THEN -1e300 ELSE CAST(t AS DOUBLE) * 0.1 - c2 END AS l2
    FROM (SELECT f.*, (o.k - f.i) = CAST(c0 = 0 AS INT) + CAST(c1 = 0 AS INT) + CAST(c2 = 0 AS INT) AS must, o.i AS j FROM f JOIN o ON o.i = f.i + 1) f JOIN o ON o.i = f.j)))
SELECT c_custkey AS tile_id, CAST(c_nationkey AS VARCHAR) AS group_id, split FROM customer JOIN o ON o.group_id = CAST(c_nationkey AS VARCHAR) JOIN f ON f.i = o.i""",
    "split_summary": f"WITH {_SPLIT} SELECT split, count(*) AS records, count(DISTINCT label) AS labels, count(DISTINCT group_id) AS groups FROM sp GROUP BY split",
    "split_integrity_violations": f"WITH {_SPLIT} SELECT group_id, count(DISTINCT split) AS splits FROM sp GROUP BY group_id HAVING count(DISTINCT split) > 1",
    "split_fingerprint": f"WITH {_SPLIT} SELECT sha256(string_agg(tile_id || chr(0) || split || chr(10), '' ORDER BY tile_id)) AS fingerprint FROM sp",
    "balanced_round_robin_sample": f"WITH {_DOCS}, o AS (SELECT tile_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('17:' || tile_id)) AS depth FROM dc) SELECT * FROM o ORDER BY depth, label LIMIT 50",
    "stratified_tail_sample": """WITH x AS (SELECT CAST(doc_id AS VARCHAR) AS tile_id, quality AS label, n_chars FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n_chars, tile_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM x),
s AS (SELECT *, 'low' AS tail FROM p WHERE place <= greatest(1, n // 4) UNION ALL SELECT *, 'high' FROM p WHERE place > n - greatest(1, n // 4) AND n > 1),
k AS (SELECT *, row_number() OVER (PARTITION BY label, tail ORDER BY sha256('17:' || tile_id)) AS pick FROM s) SELECT tile_id, CAST(label AS BIGINT) AS label, tail, n_chars FROM k WHERE pick <= 5""",
    "band_statistics_exact": """WITH v AS (SELECT l_returnflag AS band, CAST(floor(l_extendedprice) AS BIGINT) AS x FROM lineitem),
h AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY x) AS i, count(*) OVER (PARTITION BY band) AS n FROM v)
SELECT band, count(*) AS count, min(x) AS min, max(x) AS max, """
    + ", ".join(f"min(x) FILTER (i >= CAST(round_even({p} * (n - 1), 0) AS BIGINT) + 1) AS {q}" for q, p in (("p01", 0.01), ("p02", 0.02), ("median", 0.5), ("p98", 0.98), ("p99", 0.99)))
    + """, round(avg(x), 6) AS mean, round(sqrt(greatest(sum(CAST(x AS DOUBLE) * x) / count(*) - (sum(CAST(x AS DOUBLE)) / count(*)) * (sum(CAST(x AS DOUBLE)) / count(*)), 0)), 6) AS sd,
round(avg(CAST(x = 0 AS INT)), 6) AS zero_fraction, round(avg(CAST(x = 1000 AS INT)), 6) AS nodata_fraction FROM h GROUP BY band""",
    "masked_band_statistics": f"WITH {_PIXELS}, v AS (" + " UNION ALL ".join(f"SELECT '{b}' AS band, {b} AS x FROM px WHERE valid" for b in ("b03", "b04", "b08", "b11")) + ") SELECT band, count(*) AS pixels, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-12), 6) AS sd FROM v GROUP BY band",
    "zscore_masked": f'WITH {_PIXELS}, m AS (SELECT avg(b03) AS m, greatest(stddev_pop(b03), 1e-12) AS s FROM px WHERE valid) SELECT tile_id, "row", round(CASE WHEN valid THEN (b03 - m) / s ELSE 0 END, 6) AS z FROM px, m',
    "metadata_summary_rollup": f"WITH {_SPLIT} SELECT label, split, count(*) AS tiles FROM sp GROUP BY ROLLUP (label, split)",
    "scene_audit_measurements": f"WITH {_SCENES} SELECT tile_id, valid_pixels, total_pixels, round(valid_fraction, 6) AS valid_fraction, round(all_zero_fraction, 6) AS all_zero_fraction, "
    + ", ".join(f"{n}_valid, round({n}_median, 6) AS {n}_median, round({n}_min, 6) AS {n}_min, round({n}_max, 6) AS {n}_max, {n}_outside" for n in ("ndwi", "mndwi", "ndvi"))
    + " FROM sm",
    "scene_audit_summary": f"WITH {_SCENES} SELECT count(*) AS scenes, round(min(valid_fraction), 6) AS valid_fraction_min, round(median(valid_fraction), 6) AS valid_fraction_median, round(max(valid_fraction), 6) AS valid_fraction_max, count(*) FILTER (valid_pixels = 0) AS scenes_without_valid, count(*) FILTER (all_zero_fraction >= 0.99) AS scenes_all_zero, "
    + ", ".join(f"count(*) FILTER ({n}_valid = 0) AS {n}_scenes_without, round(min({n}_min), 6) AS {n}_min, round(max({n}_max), 6) AS {n}_max, CAST(sum({n}_outside) AS BIGINT) AS {n}_outside, CAST(sum({n}_valid) AS BIGINT) AS {n}_valid" for n in ("ndwi", "mndwi", "ndvi"))
    + " FROM sm",
    "judgment_precision_bounds": """WITH j AS (SELECT doc_id % 20 AS query_id, toxic = 1 AS labelled, CASE WHEN quality = 0 THEN 'uncertain' WHEN doc_id % 3 = 0 THEN 'relevant' ELSE 'not_relevant' END AS d FROM labels)
SELECT query_id, count(*) AS judged_count, count(*) FILTER (d = 'relevant') AS relevant, count(*) FILTER (d = 'uncertain') AS uncertain, count(*) FILTER (d = 'not_relevant') AS not_relevant,
round(avg(CASE WHEN d <> 'uncertain' THEN CAST(labelled = (d = 'relevant') AS INT) END), 6) AS agreement, round(count(*) FILTER (d = 'relevant') / count(*), 6) AS precision_lower,
round(count(*) FILTER (d IN ('relevant', 'uncertain')) / count(*), 6) AS precision_upper FROM j GROUP BY query_id""",
    "place_search": f"""WITH {_PLACES}, h AS (SELECT *, CASE WHEN list_contains(names, 'nation_1') THEN 0 WHEN len(list_filter(names, lambda x: contains(x, 'nation_1'))) > 0 THEN 1 END AS score FROM nm)
SELECT place_id, name, level, country, CAST(score AS BIGINT) AS score FROM h WHERE score IS NOT NULL ORDER BY score, name, country, place_id LIMIT 20""",
    "place_search_by_country": f"""WITH {_PLACES}, c AS (SELECT unnest(names) AS n FROM nm WHERE level = 'country' AND list_contains(names, 'region 2') UNION SELECT 'region 2'),
h AS (SELECT *, CASE WHEN list_contains(names, 'nation') THEN 0 WHEN len(list_filter(names, lambda x: contains(x, 'nation'))) > 0 THEN 1 END AS score FROM nm WHERE level = 'admin1' AND lower(country) IN (SELECT n FROM c))
SELECT place_id, name, level, country, CAST(score AS BIGINT) AS score FROM h WHERE score IS NOT NULL ORDER BY score, name, country, place_id LIMIT 20""",
    "tile_catalog_search": "SELECT c_name AS tile_id, c_mktsegment AS label FROM customer WHERE contains(lower(c_name), '0001') ORDER BY c_name LIMIT 200",
    "bbox_intersect_filter": """WITH b AS (SELECT c_custkey AS tile_id, CASE WHEN c_custkey % 7 = 0 THEN 178.0 ELSE c_custkey % 360 - 180 END::DOUBLE AS west, (c_custkey % 160 - 80)::DOUBLE AS south FROM customer),
c AS (SELECT tile_id, west, south, CASE WHEN tile_id % 7 = 0 THEN -178.0 ELSE least(west + 2, 180.0) END AS east, south + 2 AS north FROM b),
p AS (SELECT *, unnest(CASE WHEN west > east THEN [[west, 180.0], [-180.0, east]] ELSE [[west, east]] END) AS lon FROM c)
SELECT DISTINCT tile_id, west, south, east, north FROM p WHERE south <= 40 AND north >= -40 AND ((lon[1] <= 180 AND lon[2] >= 170) OR (lon[1] <= -170 AND lon[2] >= -180))""",
    "pair_source_label_join": "SELECT doc_id, lang, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id)",
    "missing_asset_report": """WITH h AS (SELECT l_orderkey AS tile_id, list(DISTINCT 'B0' || l_linenumber) AS have FROM lineitem GROUP BY 1),
m AS (SELECT o_orderkey AS tile_id, list_filter(['B01','B02','B03','B04','B05','B06','B07'], lambda x: NOT list_contains(coalesce(have, []), x)) AS gone FROM orders LEFT JOIN h ON h.tile_id = o_orderkey)
SELECT tile_id, array_to_string(gone, ',') AS missing, CASE WHEN len(gone) = 0 THEN 'available' ELSE 'missing' END AS asset_status FROM m""",
    "duplicate_key_report": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
    "id_set_difference": "SELECT doc_id, 'first' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'second' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)",
    "d4_transform_pixels": f"WITH {_GRID} " + " UNION ALL ".join(
        f'SELECT tile_id, cell, CAST({t} AS BIGINT) AS quarter_turns, {str(f).lower()} AS flipped, CAST({r} AS BIGINT) AS "row", CAST({f"15 - ({c})" if f else c} AS BIGINT) AS col FROM gr' for t, (r, c) in _D4.items() for f in (False, True)
    ),
    "percentile_stretch_uint8": f"""WITH {_GRID}, e AS (SELECT tile_id, quantile_cont(value, 0.02) FILTER (valid) AS lo, quantile_cont(value, 0.98) FILTER (valid) AS up0 FROM gr GROUP BY tile_id),
f AS (SELECT tile_id, lo, CASE WHEN up0 <= lo THEN lo + 1 ELSE up0 END AS up FROM e)
SELECT tile_id, cell, CAST(round_even(greatest(0.0, least(1.0, (value - lo) / (up - lo))) * 255, 0) AS BIGINT) AS stretched FROM gr JOIN f USING (tile_id)""",
    "nt_xent_loss": """WITH z AS (SELECT vec_id AS i, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS z FROM embeddings),
l AS (SELECT a.i, b.i AS j, list_dot_product(a.z, b.z) / 0.1 AS s FROM z a JOIN z b ON a.i // 128 = b.i // 128 WHERE a.i <> b.i),
m AS (SELECT i, max(s) AS m, max(s) FILTER (j = CASE WHEN i % 2 = 0 THEN i + 1 ELSE i - 1 END) AS p FROM l GROUP BY i),
r AS (SELECT l.i, any_value(m) + ln(sum(exp(s - m))) - any_value(p) AS loss, CAST(any_value(p) = any_value(m) AS INT) AS hit FROM l JOIN m ON m.i = l.i GROUP BY l.i)
SELECT count(*) AS anchors, round(avg(loss), 6) AS loss, round(avg(hit), 6) AS accuracy FROM r""",
    "multilabel_from_masks": """WITH c AS (SELECT ['double_plant', 'drydown', 'endrow', 'nutrient_deficiency', 'planter_skip', 'storm_damage', 'water', 'waterway', 'weed_cluster'] AS n),
h AS (SELECT DISTINCT l_orderkey AS tile_id, l_linenumber % 9 AS k FROM lineitem WHERE l_discount >= 0.05 AND l_returnflag <> 'R' AND l_linestatus = 'O')
SELECT t.tile_id, coalesce(string_agg(c.n[h.k + 1], ',' ORDER BY h.k), '') AS labels FROM (SELECT DISTINCT l_orderkey AS tile_id FROM lineitem) t LEFT JOIN h USING (tile_id), c GROUP BY t.tile_id""",
    "gazetteer_build": """WITH f AS (SELECT n_nationkey AS nth, n_name AS name, CAST(n_regionkey AS VARCHAR) AS country,
  'admin1:' || CASE WHEN n_nationkey % 5 <> 0 THEN 'n' || (n_nationkey % 7) ELSE trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') END AS base FROM nation),
g AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY nth) AS again FROM f)
SELECT CASE WHEN again > 1 THEN base || ':feature-' || nth ELSE base END AS place_id, 'admin1' AS level, name, country, name || ',x,y ' || country AS aliases FROM g""",
    "asset_key_counts": "SELECT event_type AS asset, count(*) AS items, regexp_matches(lower(event_type), 'cloud|shadow|scl|mask|quality|qa') AS speaks_of_quality FROM events GROUP BY event_type",
    "json_metadata_lookup": "WITH k AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(k) AS with_k, CAST(sum(k) AS BIGINT) AS total_k, max(k) AS most_k FROM k GROUP BY event_type",
}


def _without_minus_zero(name: str, *columns: str) -> None:
    """Rounding a small negative number gives -0.0 here and 0.0 in Spark."""
    SQL[name] = f"SELECT * REPLACE ({', '.join(f'{c} + 0.0 AS {c}' for c in columns)}) FROM ({SQL[name]})"


_without_minus_zero("spectral_index_values", "ndwi", "mndwi", "ndvi")
_without_minus_zero("spectral_scene_summary", "mean", "median")
_without_minus_zero("scene_audit_measurements", *[f"{n}_{k}" for n in ("ndwi", "mndwi", "ndvi") for k in ("median", "min", "max")])
