"""SQL texts of the operators that SQL can express, for DuckDB on whole small tables."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every window of 200 bytes by its digest; runs of the repeated ones; what lies between the runs.
REPEATS = """
WITH t AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i:i + 199]) AS h FROM (SELECT r, b, unnest(generate_series(1, octet_length(b) - 199)) AS i FROM t WHERE octet_length(b) >= 200)),
hit AS (SELECT r, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS e FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM hit)) GROUP BY r, g),
gaps AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 1) AS f, a AS u FROM (SELECT r, a, e FROM runs UNION ALL SELECT r, octet_length(b) + 1, NULL FROM t)),
kept AS (SELECT r, list_reduce(list(b[f:u - 1] ORDER BY f), lambda x, y: x || y) AS k FROM gaps JOIN t USING (r) GROUP BY r),
n AS (SELECT r, sum(e - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(k) AS kept_sha256
FROM t JOIN kept USING (r) LEFT JOIN n USING (r)
"""

#: Windows of items and of documents as joined words.
LEAKS = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS w FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)),
places AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w FROM (SELECT r, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM windows) WHERE len(ws) >= k)),
hits AS (SELECT r, item_id, i, p.k FROM places p JOIN windows USING (k, w)),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS x FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN items USING (r)
"""

#: All pairs that share a shingle, and what can be reached over the links.
NEAR_GROUPS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 1, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * met >= 80 * (p.n + q.n - met)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN reach ON a = doc_id GROUP BY doc_id, n
"""
