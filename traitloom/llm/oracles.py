"""DuckDB SQL of the queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

#: A-Z in lower case, all other characters as they are.
LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SPACED = r"'[^\x20\x09-\x0D]+'"

#: Documents are told apart by a row number, as ids may repeat.
OP3 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWER.format(c='text')}, {SPACED}) AS w FROM documents),
t AS (SELECT k, doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || chr(10) || w[i + 1])) ELSE w END AS s FROM d),
c AS (SELECT min(k) AS rep, list_sort(s) AS key, len(s) AS n FROM t WHERE len(s) > 0 GROUP BY 2, 3),
m AS (SELECT t.k, rep FROM t JOIN c ON list_sort(s) = key),
e AS (SELECT rep, n, unnest(key) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
g AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (na + nb - shared)),
h AS (SELECT a, b FROM g UNION ALL SELECT b, a FROM g),
r(node, seen) AS (SELECT rep, rep FROM c UNION SELECT r.node, h.b FROM r JOIN h ON r.seen = h.a),
o AS (SELECT r.node, min(t.doc_id) AS least FROM r JOIN m ON m.rep = r.seen JOIN t ON t.k = m.k GROUP BY 1)
SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, CASE WHEN len(t.s) > 0 THEN o.least ELSE t.doc_id END AS component_id,
  t.doc_id IS NOT DISTINCT FROM CASE WHEN len(t.s) > 0 THEN o.least ELSE t.doc_id END AS kept
FROM t LEFT JOIN m ON m.k = t.k LEFT JOIN o ON o.node = m.rep
"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWER.format(c='text')}, {ALNUM}) AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all({LOWER.format(c='text')}, {ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT item, least(len(w), 10) AS m, w FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT item, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS x FROM v),
z AS (SELECT DISTINCT m FROM s),
u AS (SELECT k, m, unnest(range(1, len(w) - m + 2)) AS i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS x FROM d, z WHERE len(w) >= m),
h AS (SELECT k, u.m, i, item FROM u JOIN s ON u.m = s.m AND u.x = s.x),
n AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT k, i, m FROM h)) GROUP BY 1),
q AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (k) LEFT JOIN q USING (k)
"""

#: Bytes as hexadecimal digits, two each; strings of 400 bytes by their digest, cut from stretches of 800.
OP10 = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT k, 400 * j AS base, substr(x, 800 * j + 1, 1600) AS y FROM (SELECT k, x, unnest(range(0, len(x) // 800)) AS j FROM d)),
g AS (SELECT k, base + i AS i, md5_number(substr(y, 2 * i + 1, 800)) AS g FROM (SELECT k, base, y, unnest(range(0, least(400, len(y) // 2 - 399))) AS i FROM s)),
t AS (SELECT g FROM g GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM g SEMI JOIN t USING (g)),
y AS (SELECT k, i, sum((before IS NULL OR i > before + 400)::INT) OVER (PARTITION BY k ORDER BY i) AS island FROM r),
c AS (SELECT k, island, min(i) AS a, max(i) + 400 AS z FROM y GROUP BY 1, 2),
p AS (SELECT k, sum(z - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM c GROUP BY 1),
f AS (SELECT d.k, doc_id, x, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, list_concat([0], coalesce(z, [])) AS b, list_concat(coalesce(a, []), [len(x) // 2]) AS e FROM d LEFT JOIN p ON p.k = d.k)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(b) + 1), lambda i: substr(x, 2 * b[i] + 1, 2 * (e[i] - b[i]))), ''))) AS kept_sha256 FROM f
"""

ORACLE_SQL = {"op3_near_dup": OP3, "op7_decontamination": OP7, "op10_suffix_dedup": OP10}
