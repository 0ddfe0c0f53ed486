"""DuckDB SQL that tells the same as some of the queries."""

OP1 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS w FROM d, unnest(range(0, n - 99)) AS r(i) WHERE n >= 100),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
new AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM late),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM new),
span AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM run GROUP BY doc_id, run),
piece AS (SELECT span.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY span.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY span.doc_id ORDER BY a), 0))) AS before FROM span JOIN d USING (doc_id)),
per AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(before, '' ORDER BY a) AS before, max(b) AS last FROM piece GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN per.doc_id IS NULL THEN h ELSE before || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN per ON per.doc_id = d.doc_id
"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), r AS (SELECT a AS node, b AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS least FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id,
  least(d.doc_id, coalesce(c.least, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""

OP8 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g FROM w, unnest(range(1, len(words) - 11)) AS r(i) WHERE len(words) >= 13),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS place FROM (SELECT g.doc_id, g.i FROM g JOIN f ON f.g = g.g WHERE g.doc_id > f.first), unnest(range(0, 13)) AS r(k)),
per AS (SELECT doc_id, list(place) AS places, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(per.n, 0) AS n_removed,
  sha256(array_to_string([w.words[i] for i in range(1, len(w.words) + 1) if per.places IS NULL OR NOT list_contains(per.places, i)], ' ')) AS kept_sha256
FROM w LEFT JOIN per ON per.doc_id = w.doc_id
"""

ORACLES = {"op1_suffix_dedup": OP1, "op4_minhash_dedup": OP4, "op8_substring_dedup": OP8}
