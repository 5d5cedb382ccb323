"""DuckDB SQL for the corpus queries that SQL can express; the others are held against brute force in the tests."""

_WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n_words FROM d),
p AS (SELECT doc_id, unnest(range(1, n_words - 11)) AS i, w FROM n WHERE n_words >= 13),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS key FROM p),
f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key),
g AS (SELECT DISTINCT doc_id, i + j AS i FROM k JOIN f USING (key), (SELECT unnest(range(0, 13)) AS j) WHERE first < doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT n.doc_id, n.n_words, CAST(coalesce(len(r.gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN r.gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(r.gone, i)) END, ' ')) AS kept_sha256
FROM n LEFT JOIN r USING (doc_id)"""

_WORD4 = r"coalesce(regexp_extract_all(translate(coalesce(text, ''), " + _AZ + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

DECONTAMINATION = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORD4} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS key FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORD4} AS w FROM documents),
s AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw USING (key) WHERE dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, (SELECT unnest(range(0, 10)) AS j) WHERE j < n GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""

_NORMAL = r"trim(regexp_replace(translate(l, " + _AZ + r"), '[\x20\x09-\x0D]+', ' ', 'g'))"
_SOLID = r"regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')"

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM p) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM l WHERE {_SOLID} <> '' GROUP BY doc_id),
host AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
freq AS (SELECT source, {_NORMAL} AS line, count(DISTINCT doc_id) AS n FROM l WHERE {_SOLID} <> '' GROUP BY ALL),
over AS (SELECT source, line FROM freq JOIN host USING (source) WHERE n > 8 AND n > 0.10 * docs),
rest AS (SELECT l.doc_id, CAST(sum(length({_SOLID})) AS BIGINT) AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM over WHERE over.source = l.source AND over.line = {_NORMAL}) GROUP BY l.doc_id),
m AS (SELECT doc_id, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d)
SELECT m.doc_id, m.n_words, coalesce(chars, 0) AS word_chars, n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  m.n_words < 20 OR 100 * coalesce(cov.n, 0) > 30 * m.n_words AS base_failed,
  NOT (m.n_words < 20 OR 100 * coalesce(cov.n, 0) > 30 * m.n_words) AND coalesce(rest.n, 0) >= 0.3 * coalesce(chars, 0) AS kept, coalesce(rest.n, 0) AS left_chars
FROM m LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN rest USING (doc_id)"""

URLS = f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), {_AZ}) AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') END AS key FROM u),
x AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) t(h, p, v)),
r AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM u JOIN x ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
b AS (SELECT DISTINCT key FROM k WHERE page_id % 100 = 0 AND key IS NOT NULL)
SELECT k.page_id, k.host, k.path, r.rule, coalesce(r.v, CASE WHEN b.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, b.key IS NOT NULL AS listed
FROM k LEFT JOIN r USING (page_id) LEFT JOIN b ON b.key = k.key"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), " + _AZ + ")")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS here FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.here),
m AS (SELECT doc_id, min(here) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""

SIMILAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), " + _AZ + ")")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS here FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.here),
m AS (SELECT doc_id, min(here) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM m LEFT JOIN n USING (doc_id)"""


def _round(r: int) -> str:
    """Assignment under the centroids of round ``r``, and the centroids of the next round."""
    return f"""
d{r} AS (SELECT vec_id, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN c{r} USING (i) GROUP BY vec_id, c),
a{r} AS (SELECT vec_id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1),
c{r + 1} AS (SELECT c, i, coalesce(m, y) AS y FROM c{r} LEFT JOIN (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id) GROUP BY c, i)) USING (c, i))"""


CLUSTERS = f"""
WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)),
s AS (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM k QUALIFY c < 16),
x AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM k),
c0 AS (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS y FROM s),{",".join(_round(r) for r in range(4))},
h AS (SELECT c, sha256(string_agg(y, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN h USING (c)"""
