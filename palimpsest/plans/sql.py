"""Pieces that the SQL of several queries shares."""

from __future__ import annotations

from palimpsest import schemas as S

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def fkey(x: str) -> str:
    return strip(f"substr({x}, 1, 60)")


def values(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


NOW = "TIMESTAMP '2024-01-31 00:00:00'"
MEMORIES = """memories AS (SELECT CAST(d.doc_id AS VARCHAR) AS pid, d.source AS collection, d.lang AS memory_type, d.text AS summary,
  coalesce(CAST(l.quality AS DOUBLE), 0.5) AS importance, [d.lang, d.source] AS entities, e.ts AS ts, v.embedding AS embedding
  FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id)"""
MESSAGES = "messages AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS message, unnest(range(len(string_split(text, chr(10))))) AS line FROM conversations)"
NODES = """nodes AS (SELECT DISTINCT c_name AS name, 'Person' AS label FROM customer UNION ALL SELECT DISTINCT n_name, 'Place' FROM nation
  UNION ALL SELECT DISTINCT r_name, 'Place' FROM region UNION ALL SELECT DISTINCT p_name, 'Product' FROM part)"""
EDGES = """edges AS (
  SELECT 'c' || c_custkey AS eid, c_name AS subj, 'LOCATED_IN' AS pred, n_name AS obj, CAST(NULL AS VARCHAR) AS status, 'crm' AS source, CAST(NULL AS TIMESTAMP) AS updated, CAST(NULL AS VARCHAR) AS superseded_by, CAST(NULL AS VARCHAR) AS ko_summary FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'PART_OF', r_name, 'active', 'geo', NULL, NULL, 'geography' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'o' || l_orderkey || '-' || l_linenumber, c_name, 'ORDERED', p_name, CASE WHEN l_linestatus = 'O' THEN 'active' ELSE 'superseded' END, o_orderpriority, l_shipdate,
    CASE WHEN l_linestatus <> 'O' AND l_returnflag = 'R' THEN p_name END, CASE WHEN l_returnflag <> 'N' THEN c_name || ' ORDERED ' || p_name END
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""
ACTIVE = "coalesce(status, 'active') = 'active'"
QUERIES = "queries AS (SELECT b.item_id AS query_id, b.text AS text, v.embedding AS embedding FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id)"


def cosine(a: str, b: str) -> str:
    x, y = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return f"round(list_dot_product({x}, {y}) / (sqrt(list_dot_product({x}, {x})) * sqrt(list_dot_product({y}, {y})) + 1e-9), 4)"


def dense(floor: float, k: int = 20, queries: str = "queries", items: str = "memories") -> str:
    return f"""vec AS (SELECT * FROM (SELECT query_id, pid, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, pid) AS rank FROM
  (SELECT q.query_id, m.pid, {cosine("q.embedding", "m.embedding")} AS sim FROM {queries} q, {items} m WHERE m.embedding IS NOT NULL) WHERE sim >= {floor}) WHERE rank <= {k})"""


TOKENS = "list_filter(regexp_extract_all(coalesce({x}, ''), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN ({stop}))"


def tokens(x: str, stop: list[str] | None = None) -> str:
    stop = S.STOP_WORDS if stop is None else stop
    return TOKENS.format(x=x, stop=values(stop or [""]))


def bm25(k: int = 20, items: str = "memories", column: str = "summary", queries: str = "queries", name: str = "lex", stop: list[str] | None = None) -> str:
    n = name
    return f"""{n}_tok AS (SELECT pid, {tokens(column, stop)} AS t FROM {items}),
  {n}_corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {n}_tok),
  {n}_post AS (SELECT pid, dl, term, count(*) AS tf FROM (SELECT pid, len(t) AS dl, unnest(t) AS term FROM {n}_tok) GROUP BY ALL),
  {n}_terms AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM (SELECT term, count(*) AS df FROM {n}_post GROUP BY term), {n}_corpus),
  {n}_idf AS (SELECT term, CASE WHEN idf0 < 0 THEN 0.25 * (SELECT avg(idf0) FROM {n}_terms) ELSE idf0 END AS idf FROM {n}_terms),
  {n}_asked AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest({tokens("text", stop)}) AS term FROM {queries}) GROUP BY ALL),
  {n}_scores AS (SELECT query_id, pid, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 4) AS raw FROM {n}_asked JOIN {n}_post USING (term) JOIN {n}_idf USING (term), {n}_corpus GROUP BY ALL),
  {n} AS (SELECT query_id, pid, raw, rank, round(raw / max(raw) OVER (PARTITION BY query_id), 4) AS norm_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, pid) AS rank FROM {n}_scores WHERE raw > 0) WHERE rank <= {k})"""


def imp(x: str, importance: str = "importance") -> str:
    return f"round({x} * (1 + (greatest(0, least(1, coalesce({importance}, 0.5))) - 0.5) * 0.5), 4)"


def days(ts: str) -> str:
    return f"greatest(CAST(epoch_us({NOW}) - epoch_us({ts}) AS DOUBLE) / 1000000.0 / 86400.0, 0.0)"


def decay(x: str, ts: str = "ts") -> str:
    return f"CASE WHEN {ts} IS NULL THEN {x} ELSE round({x} * (1 - 0.25 * least({days(ts)} / 540.0, 1.0)), 4) END"


def first_key(channel: str, score: str) -> str:
    return f"SELECT * FROM (SELECT query_id, pid, summary, importance, ts, entities, {score} AS score, rank, {fkey('summary')} AS fkey, row_number() OVER (PARTITION BY query_id, {fkey('summary')} ORDER BY rank, pid) AS n FROM {channel} JOIN memories USING (pid)) WHERE n = 1 AND fkey <> ''"


ARITHMETIC = f"""v1 AS ({first_key("vec", "sim")}), b1 AS ({first_key("lex", "norm_score")}),
  arith0 AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.fkey, b.fkey) AS fkey, coalesce(v.pid, b.pid) AS pid, coalesce(v.summary, b.summary) AS summary, coalesce(v.importance, b.importance) AS importance, CASE WHEN v.pid IS NULL THEN b.ts ELSE v.ts END AS ts, coalesce(v.score, b.score) AS orig,
    CASE WHEN v.score IS NOT NULL AND b.score >= 0.62 THEN 'vec,bm25' WHEN v.score IS NOT NULL THEN 'vec' ELSE 'bm25' END AS channels,
    CASE WHEN v.score IS NOT NULL AND b.score >= 0.62 THEN round(sqrt(v.score * b.score) * 1.8, 4) ELSE round(coalesce(v.score, b.score) * 0.7, 4) END AS fused
    FROM v1 v FULL JOIN b1 b ON v.query_id = b.query_id AND v.fkey = b.fkey WHERE v.score IS NOT NULL OR b.score >= 0.62),
  arith AS (SELECT *, {decay(imp("fused"))} AS sort_key FROM arith0 WHERE channels = 'vec,bm25' OR (orig > 0 AND fused / orig >= 0.5))"""
