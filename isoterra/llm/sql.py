"""DuckDB SQL that gives the same rows as the queries."""

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS g
  FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
links AS (
  SELECT a.doc_id AS p, b.doc_id AS q FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(v, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT links.q, reach.r FROM reach JOIN links ON links.p = reach.v)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, c.component_id
FROM s JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) c ON c.v = s.doc_id
"""

OP2 = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
wins AS (
  SELECT r, i, array_to_string(ws[i:i+34], ' ') AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
again AS (SELECT x FROM wins GROUP BY x HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + unnest(range(0, 35)) AS i FROM wins WHERE x IN (FROM again)),
kept AS (
  SELECT t.r, string_agg(t.x, ' ' ORDER BY t.i) AS k, count(*) AS n
  FROM (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w) t ANTI JOIN gone g ON t.r = g.r AND t.i = g.i
  GROUP BY t.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

OP10 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS l, len(x) AS d FROM v),
links AS (
  SELECT a.vec_id AS p, b.vec_id AS q FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.d = b.d AND list_dot_product(a.x, b.x) / (a.l * b.l) >= 0.9),
reach(v, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.q, reach.r FROM reach JOIN links ON links.p = reach.v),
c AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v),
k AS (SELECT p, count(*) AS n_links FROM links GROUP BY p)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON v = vec_id LEFT JOIN k ON p = vec_id
"""

_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
_FOUND = " UNION ALL ".join(f"SELECT r, {i} AS rank, '{k}' AS kind, regexp_extract_all(t, '{p}', 0) AS ms, string_split_regex(t, '{p}') AS ps FROM d" for i, (k, p) in enumerate(_KINDS))
_PLACE = "(list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda q: length(q))), 0))::BIGINT"
OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({_FOUND})),
x AS (SELECT r, rank, kind, ms[i] AS v, regexp_replace(ms[i], '[^0-9]', '', 'g') AS g, {_PLACE} AS s FROM m),
b AS (
  SELECT r, rank, kind, v, s, s + length(v) AS e FROM x WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(left(ltrim(p, '0'), 4) AS INT), 0) > 255)) = 0
    WHEN 'card' THEN length(g) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda k: CASE WHEN k % 2 = 1 THEN substring(reverse(g), k, 1)::INT ELSE 2 * substring(reverse(g), k, 1)::INT - CASE WHEN substring(reverse(g), k, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    ELSE length(g) BETWEEN 9 AND 15 END),
runs AS (
  SELECT r, right(ms[i], 64) AS w, {_PLACE} + greatest(length(ms[i]) - 64, 0) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '\p{{L}}+') AS ms, string_split_regex(t, '\p{{L}}+') AS ps FROM d)) WHERE length(ms[i]) >= 4),
terms AS (SELECT lower(w) AS term, count(DISTINCT r) AS nt FROM runs GROUP BY 1),
free AS (
  SELECT r, lower(w) AS term, s, s + length(w) AS e FROM runs
  WHERE r IN (SELECT r FROM b) AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = runs.r AND runs.s < b.e AND b.s < runs.s + length(w))),
has AS (SELECT DISTINCT r, kind || ':' || v AS entity FROM b),
ents AS (SELECT entity, count(*) AS ne FROM has GROUP BY entity),
pairs AS (SELECT term, entity, count(DISTINCT r) AS nb FROM free JOIN has USING (r) GROUP BY term, entity HAVING count(DISTINCT r) >= 2),
total AS (SELECT count(*)::DOUBLE AS n FROM d),
gives AS (SELECT term, entity FROM pairs JOIN ents USING (entity) JOIN terms USING (term), total WHERE log2(n / ne) > 0 AND log2(n * nb / (nt * ne)) >= 0.9 * log2(n / ne)),
found AS (SELECT DISTINCT r, 4 AS rank, 'term' AS kind, s, e FROM free JOIN has USING (r) SEMI JOIN gives USING (term, entity)),
every AS (SELECT r, rank, kind, s, e FROM b UNION ALL SELECT * FROM found),
lines AS (
  SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM every GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN lines USING (r)
"""
