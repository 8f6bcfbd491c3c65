r"""DuckDB SQL for the subpackage's queries, written from the contract rather than from the operators."""

WORD = r"[^\x20\x09-\x0D]+"

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, 0 AS k, 'assign' AS kind, regexp_extract_all(t, '{_ASSIGN}', 0) AS m,
         regexp_extract_all(t, '{_ASSIGN}', 2) AS g, string_split_regex(t, '{_ASSIGN}') AS p FROM d
  UNION ALL
  SELECT doc_id, 1, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]{{14,}}', 0), NULL, string_split_regex(t, 'AKIA[A-Z0-9]{{14,}}') FROM d
  UNION ALL
  SELECT doc_id, 2, 'hex', regexp_extract_all(t, '[0-9a-f]{{16,}}', 0), NULL, string_split_regex(t, '[0-9a-f]{{16,}}') FROM d),
s AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m WHERE len(m) > 0),
e AS (
  SELECT doc_id, k, kind,
         CAST(list_sum(list_transform(p[1:i], lambda x: length(x)))
              + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS b,
         length(m[i]) AS n
  FROM s WHERE k > 0 OR length(g[i]) >= 12),
r AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
         string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, k) AS said
  FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(said, '')) AS base_sha256, coalesce(said, '') AS spans
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""

OP3 = rf"""
WITH RECURSIVE z AS (
  SELECT doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
y AS (
  SELECT doc_id, source, size, CASE WHEN size < 32 OR size >= 8192 THEN CAST(0.5 AS DOUBLE) ELSE 1 END AS pull,
         '17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || h || ':'
           || row_number() OVER (PARTITION BY doc_id, h) AS k FROM z),
q AS (
  SELECT doc_id, source, size, pull, (CAST('0x' || substr(md5(k), 1, 13) AS BIGINT) + 0.5) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM y),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM q GROUP BY source),
n AS (
  SELECT source, source_size, CAST(3.0 AS DOUBLE) * source_size AS stop,
         [CAST(5 AS DOUBLE), 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM a),
fill(turn, source, target, stop, w, source_size) AS (
  SELECT 0, source, CAST(0 AS DOUBLE), stop, w, source_size FROM n
  UNION ALL
  SELECT turn + 1, source, CASE WHEN target >= stop THEN stop ELSE least(stop, w
           * (sum(source_size) OVER () - sum(CASE WHEN target >= stop THEN stop ELSE 0 END) OVER ())
           / sum(CASE WHEN target >= stop THEN 0 ELSE w END) OVER ()) END, stop, w, source_size
  FROM fill WHERE turn < 64),
t AS (SELECT source, source_size, target FROM fill WHERE turn = 64),
g AS (SELECT source, sum(CASE WHEN pull = 1 THEN size ELSE 0 END) AS full_size, sum(CASE WHEN pull < 1 THEN size ELSE 0 END) AS half_size FROM q GROUP BY source),
l AS (
  SELECT t.*, CASE WHEN full_size + 0.5 * half_size > 0 AND target / (full_size + 0.5 * half_size) <= 3 THEN target / (full_size + 0.5 * half_size)
                   WHEN half_size > 0 THEN (target - CAST(3 AS DOUBLE) * full_size) / (0.5 * half_size) ELSE 3 END AS level
  FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source),
x AS (
  SELECT q.*, l.source_size, l.target, CASE WHEN l.source_size > 0 THEN least(CAST(3 AS DOUBLE), level * pull) ELSE 0 END AS e
  FROM q JOIN l ON q.source IS NOT DISTINCT FROM l.source),
r AS (SELECT *, floor(e) AS copies, e - floor(e) AS p FROM x),
o AS (SELECT *, u / (1 - u) / (p / (1 - p)) AS rank FROM r WHERE p > 0),
k AS (SELECT *, rank / (1 + rank) AS key FROM o),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto FROM k),
s AS (SELECT source, any_value(target) - sum(copies * size) AS rest FROM r GROUP BY source),
b AS (
  SELECT c.source, arg_min(key, abs(upto - rest)) AS cut FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source
  WHERE abs(upto - rest) < rest GROUP BY c.source)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST(r.size * (r.copies + CASE WHEN r.p > 0 AND b.cut IS NOT NULL
         AND r.u / (1 - r.u) / (r.p / (1 - r.p)) / (1 + r.u / (1 - r.u) / (r.p / (1 - r.p))) <= b.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r LEFT JOIN b ON r.source IS NOT DISTINCT FROM b.source
"""

OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM h)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def _op11(k: int = 8, width: int = 64, rounds: int = 10) -> str:
    """The rounds one after another, each a pair of tables."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c FROM embeddings
  WHERE len(embedding) = {width} AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {width})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, c) - 1 AS z, c FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, c) <= {k})""",
    ]
    apart = "list_sum([CAST((p[1] - p[2]) * (p[1] - p[2]) AS BIGINT) FOR p IN list_zip(v.c, t.c)])"
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT v.n, any_value(v.vec_id) AS vec_id, any_value(v.c) AS c,
  arg_min(t.z, [{apart}, t.z]) AS z, min({apart}) AS d FROM v CROSS JOIN c{r} t GROUP BY v.n)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS MATERIALIZED (SELECT z, i, CAST(sum(c[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, {width + 1}) g(i) GROUP BY z, i),
c{r + 1} AS MATERIALIZED (SELECT t.z, coalesce((SELECT list((s - ((s % n) + n) % n) // n ORDER BY i) FROM m{r} WHERE m{r}.z = t.z), t.c) AS c FROM c{r} t)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a{rounds}.z AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.z) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(t.c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} t ON a{rounds}.z = t.z"""


OP11 = _op11()

OP12 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS c,
         coalesce(label IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
                  AND len([1 FOR x IN embedding IF x <> 0]) > 0, false) AS ok FROM embeddings),
e AS MATERIALIZED (
  SELECT a.n, b.n AS m FROM v a JOIN v b ON a.label = b.label AND a.n <> b.n AND a.ok AND b.ok AND len(a.c) = len(b.c)
  WHERE list_inner_product(a.c, b.c) / (sqrt(list_inner_product(a.c, a.c)) * sqrt(list_inner_product(b.c, b.c))) >= CAST(0.93 AS DOUBLE)),
r(n, m) AS (SELECT n, n FROM v UNION SELECT r.n, e.m FROM r JOIN e ON r.m = e.n),
k AS (SELECT r.n, min(o.vec_id) AS component_id FROM r JOIN v o ON o.n = r.m GROUP BY r.n)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.n = v.n) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN k ON v.n = k.n
"""

OP13 = rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(k, '')])),
    lambda c, x: xor(xor(c, x) >> 1, CAST(3988292384 AS BIGINT) * (xor(c, x) & 1))), CAST(4294967295 AS BIGINT)) % 20 AS m FROM d),
b AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
         CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE m WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
o AS (
  SELECT *, left(role, 1) AS f, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n FROM b),
g AS MATERIALIZED (
  SELECT *, lag(f) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '{WORD}') THEN 1 WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 2
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM o),
p AS MATERIALIZED (SELECT *, CASE fault WHEN 3 THEN 3 WHEN 0 THEN 0 ELSE 1000000000 END AS stays,
       [CASE f WHEN 's' THEN 1 WHEN 'u' THEN 2 END, CASE f WHEN 'u' THEN 2 END, CASE f WHEN 'a' THEN 3 END, CASE f WHEN 'u' THEN 2 END] AS kept FROM g),
w(conv_id, i, c) AS (
  SELECT DISTINCT conv_id, n + 1, [0, 6, 3, 0] FROM g
  UNION ALL
  SELECT conv_id, i, [least(e[1], 3 + least(e[3], 3 + e[4])), least(e[2], 3 + least(e[3], 3 + e[4])), least(e[3], 3 + e[4]), least(e[4], 3 + e[3])]
  FROM (SELECT p.conv_id, p.i, [CAST(least(4 + c[q], coalesce(c[kept[q] + 1] + stays, 1000000000), 3 + stays + c[CASE q WHEN 3 THEN 4 ELSE 3 END]) AS INTEGER) FOR q IN [1, 2, 3, 4]] AS e
        FROM w JOIN p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i - 1)),
v AS MATERIALIZED (SELECT * FROM w),
x(conv_id, i, q, audit, lines, cost) AS (
  SELECT conv_id, CAST(1 AS BIGINT), 0, '', CAST([] AS VARCHAR[]), c[1] FROM v WHERE i = 1
  UNION ALL
  SELECT conv_id, i + CASE letter WHEN 'I' THEN 0 ELSE 1 END,
         CASE letter WHEN 'D' THEN q WHEN 'K' THEN kept[q + 1] ELSE due END, audit || letter,
         CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
              ELSE list_append(lines, CASE due WHEN 3 THEN 'assistant:' ELSE 'user:' END || CASE letter WHEN 'R' THEN text ELSE '' END) END, cost
  FROM (SELECT x.*, p.role, p.text, p.kept, CASE q WHEN 2 THEN 3 ELSE 2 END AS due,
          CASE WHEN v.c[q + 1] = 4 + u.c[q + 1] THEN 'D' WHEN v.c[q + 1] = 3 + v.c[CASE q WHEN 2 THEN 4 ELSE 3 END] THEN 'I'
               WHEN v.c[q + 1] = stays + u.c[kept[q + 1] + 1] THEN 'K' WHEN p.i IS NOT NULL THEN 'R' END AS letter
        FROM x JOIN v ON v.conv_id IS NOT DISTINCT FROM x.conv_id AND v.i = x.i
        LEFT JOIN v u ON u.conv_id IS NOT DISTINCT FROM x.conv_id AND u.i = x.i + 1
        LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM x.conv_id AND p.i = x.i)
  WHERE letter IS NOT NULL),
s AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
             count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND before || f NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM g GROUP BY conv_id),
r AS (SELECT x.* FROM x JOIN s ON s.conv_id IS NOT DISTINCT FROM x.conv_id WHERE x.i = s.n + 1 AND x.q IN (0, 3))
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
