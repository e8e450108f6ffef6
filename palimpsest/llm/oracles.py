"""DuckDB SQL of the training-data queries that SQL can express, written from their contracts.

Not expressible: op2 (the seeded order is a hash that DuckDB lacks), op3 and op4 (trees, fitted scorers), op5 (the tokenizer), op10 (crc32, area
resizing). tests/llm holds those against brute force.
"""

from __future__ import annotations

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = f"""
WITH lines AS (
  SELECT doc_id, unnest(line) AS line, unnest(range(len(line))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS line FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {LOWER}) AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT doc_id, line, pos, coalesce(first < doc_id, false) AS dropped FROM keyed LEFT JOIN firsts USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

#: Bytes as hexadecimal digits, two a byte; windows meet by DuckDB's 64-bit hash.
OP6 = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
  SELECT doc_id, s, hash(substr(x, 2 * s + 1, 400)) AS h
  FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 199)) AS s FROM bytes WHERE len(x) >= 400)
), twice AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), starts AS (
  SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM windows SEMI JOIN twice USING (h)
), islands AS (
  SELECT doc_id, s, sum(CASE WHEN s <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM starts
), spans AS (
  SELECT doc_id, min(s) AS lo, max(s) + 200 AS hi FROM islands GROUP BY doc_id, island
), pieces AS (
  SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS after FROM spans
), left_over AS (
  SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last, string_agg(substr(x, 2 * after + 1, 2 * (lo - after)), '' ORDER BY lo) AS head
  FROM pieces JOIN bytes USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN left_over USING (doc_id)
"""

OP7 = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i + 1:i + 5], ' ') FOR i IN range(len(w) - 4)] END) AS g
  FROM worded
), sized AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingled a JOIN shingled b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sized x ON a = x.doc_id JOIN sized y ON b = y.doc_id WHERE 100 * common >= 75 * (x.n + y.n - common)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION
  SELECT both_ways.b, reach.r FROM reach JOIN both_ways ON reach.v = both_ways.a WHERE reach.r < both_ways.b
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT v AS doc_id, min(r) AS component_id FROM reach GROUP BY v) LEFT JOIN sized USING (doc_id)
"""

#: The verdict of pages without a rule is their host's own share of rules: no page of these tables links to another host (a test holds that), so
#: nothing propagates. Propagation is tested against a dense PageRank.
OP8 = f"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {LOWER}) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), rules(h, p, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), ruled AS (
  SELECT host, path, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM split) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path
), judged AS (
  SELECT page_id, split.host, split.path, rule, verdict FROM split LEFT JOIN ruled ON split.host = ruled.host AND split.path = ruled.path
), shares AS (
  SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END::DOUBLE) AS trust, avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END::DOUBLE) AS distrust FROM judged WHERE host <> '' GROUP BY host
)
SELECT page_id, judged.host, path, rule, coalesce(verdict, CASE WHEN distrust - trust > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0.0::DOUBLE) AS trust, coalesce(distrust, 0.0::DOUBLE) AS distrust
FROM judged LEFT JOIN shares ON judged.host = shares.host
"""

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP9 = f"""
WITH items AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT *, unnest(range(len(w) - n + 1)) AS i FROM items)
), docs AS (
  SELECT doc_id, {WORDS} AS w FROM documents
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, g)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op6_suffix_dedup": OP6, "op7_near_dedup": OP7, "op8_url_filters": OP8, "op9_decontamination": OP9}
