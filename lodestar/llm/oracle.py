"""SQL for the queries that SQL can express, to run on whole tables."""

from __future__ import annotations

#: Lower-case A-Z only, as the operator does.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: All pairs that share a shingle, and the least document that a chain of links leads to.
NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, x, count(*) AS n FROM (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)) GROUP BY ALL),
size AS (SELECT doc_id, sum(n) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS alike FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE alike >= 0.8 * (x.n + y.n - alike) - 1e-9),
near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS c FROM near UNION SELECT reach.doc_id, near.b FROM reach JOIN near ON reach.c = near.a),
head AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(least(c, doc_id), doc_id) AS class_id, doc_id = coalesce(least(c, doc_id), doc_id) AS is_kept FROM d LEFT JOIN head USING (doc_id)
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM dup),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
t AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM t),
win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, win.n, item_id FROM win JOIN t ON win.s = t.s AND win.n = t.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
run AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
    SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -999) + 200)::INT AS fresh FROM dup)) GROUP BY doc_id, k),
piece AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM run),
kept AS (SELECT doc_id, count(*) AS n, sum(z - a)::BIGINT AS gone, max(z) AS last,
  string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS part FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans,
sha256(unhex(coalesce(part, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
