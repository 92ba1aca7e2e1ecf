"""DuckDB texts of the ``opN_<name>`` queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Shingle sets, pairs counted over shared shingles, and the closure of the links.
NGRAM_JOIN = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
runs AS (
  SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM placed),
shingles AS (SELECT DISTINCT doc_id, run FROM runs WHERE i <= greatest(n - 2, 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, md5(string_agg(run, chr(10) ORDER BY run)) AS name FROM shingles GROUP BY doc_id),
same AS (SELECT min(doc_id) AS node, any_value(n) AS n, name FROM named GROUP BY name),
entries AS (SELECT s.run, c.node, c.n FROM shingles s JOIN same c ON c.node = s.doc_id),
pairs AS (
  SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS common
  FROM entries a JOIN entries b ON a.run = b.run AND a.node < b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 90 * (na + nb - common)),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, seen) AS (
  SELECT node, node FROM same
  UNION
  SELECT r.node, e.b FROM reach r JOIN ends e ON e.a = r.seen),
low AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id
FROM docs d LEFT JOIN named m USING (doc_id) LEFT JOIN same c ON c.name = m.name LEFT JOIN low l ON l.node = c.node
"""

#: Equal payloads, and SHA-1 digests turned from hexadecimal to base 32 by way of bits.
WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(hex, i, 1)) - 3, 4)), 'string_agg', '') AS bits,
         min(page_id) OVER (PARTITION BY html) AS least
  FROM p)
SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM b
"""

#: Integer inner products of every query with every row.
COVER_TREE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

#: Windows of 35 words spelled out and counted; a word goes when a repeated window began at most 34 words before it.
SUBSTRINGS = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
placed AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
windows AS (
  SELECT r, i, word, string_agg(word, ' ') OVER f AS run, count(*) OVER f AS n FROM placed
  WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
repeated AS (SELECT run FROM windows WHERE n = 35 GROUP BY run HAVING count(*) > 1),
begun AS (SELECT w.r, w.i, w.word, w.n = 35 AND p.run IS NOT NULL AS begins FROM windows w LEFT JOIN repeated p ON p.run = w.run),
judged AS (SELECT r, i, word, bool_or(begins) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM begun),
kept AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM judged GROUP BY r)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (r)
"""

ORACLES = {"op1_ngram_join": NGRAM_JOIN, "op5_warc": WARC, "op9_cover_tree": COVER_TREE, "op10_substrings": SUBSTRINGS}
