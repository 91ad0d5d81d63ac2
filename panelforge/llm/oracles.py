"""Independent DuckDB statements for the queries that SQL can express."""

_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_ASCII}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), tokens AS (
  SELECT doc_id, len(s) AS m, unnest(s) AS tok FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.m AS ma, b.m AS mb, count(*) AS n
  FROM tokens a JOIN tokens b ON a.tok = b.tok AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE 100 * n >= 80 * (ma + mb - n)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(node, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.seen = e.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.seen) AS component_id
FROM sets s JOIN reach r ON s.doc_id = r.node GROUP BY s.doc_id, s.s
"""

BLOCK_NAMING = f"""
WITH t AS (SELECT doc_id, {_ASCII} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

REPEATED_PASSAGES = rf"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_ASCII}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(len(w) - 49)) AS k, unnest(list_transform(range(1, len(w) - 48), lambda i: array_to_string(w[i:i+49], ' '))) AS g FROM words WHERE len(w) >= 50
), again AS (
  SELECT g FROM windows GROUP BY g HAVING min(doc_id) <> max(doc_id)
), found AS (
  SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS fresh FROM windows SEMI JOIN again USING (g)
), spans AS (
  SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS span FROM found
)
SELECT doc_id, min(k) AS start_word, max(k) + 50 AS end_word, max(k) + 50 - min(k) AS n_words FROM spans GROUP BY doc_id, span
"""

_FIT = "((host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '/{p}'))"
_RULE_CASE = "CASE " + " ".join(f"WHEN {_FIT.format(h=r.partition('/')[0], p=r.partition('/')[2])} THEN '{r}'" for r in ("example.net/en/", "example.com/de/", "org/fr/", "net/")) + " END"

#: Walks along links are followed one by one, 60 steps at most: enough where links don't go round.
LINK_GRAPH = rf"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), judged AS (
  SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM (SELECT *, {_RULE_CASE} AS rule FROM parts)
), hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad FROM judged WHERE host <> '' GROUP BY host
), named AS (
  SELECT host AS src, lower(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s<>]+)', 1))) AS dst FROM judged WHERE host <> ''
), links AS (
  SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM named WHERE src <> dst GROUP BY src, dst
  UNION ALL SELECT a.host, arg_max(b.host, length(b.host)), 1.0 FROM hosts a JOIN hosts b ON suffix(a.host, '.' || b.host) GROUP BY a.host
), edges AS (
  SELECT 1 AS kind, src, dst, w FROM links UNION ALL SELECT -1, dst, src, w FROM links
), moves AS (
  SELECT kind, src, dst, sum(w) / sum(sum(w)) OVER (PARTITION BY kind, src) AS p FROM edges GROUP BY kind, src, dst
), seeds AS (
  SELECT 1 AS kind, host, n / sum(n) OVER () AS mass FROM hosts WHERE good >= n * 0.5 UNION ALL SELECT -1, host, n / sum(n) OVER () FROM hosts WHERE bad >= n * 0.5
), walk AS (
  SELECT kind, host, CAST(mass AS DOUBLE) AS mass, 0 AS step FROM seeds
  UNION ALL SELECT w.kind, m.dst, w.mass * m.p * 0.85, w.step + 1 FROM walk w JOIN moves m ON w.kind = m.kind AND w.host = m.src WHERE w.step < 60
), ranks AS (
  SELECT kind, host, sum(mass) / sum(sum(mass)) OVER (PARTITION BY kind) AS r FROM walk GROUP BY kind, host
), bad AS (
  SELECT host FROM ranks GROUP BY host HAVING sum(kind * r) < -1e-9
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""
