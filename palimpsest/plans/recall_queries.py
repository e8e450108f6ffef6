"""Recall with the graph, the upper layers and models, over a graph whose names are the records' entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans import recall as R
from palimpsest.plans import sql as Q
from palimpsest.plans.catalog import query
from palimpsest.plans.search_queries import FOUND, NCH, STEPS, P
from palimpsest.sources import adapters as A

P_GRAPH = P.with_(gate_max_len=100_000)
#: Benchmark texts that also name a source, which the records have among their entities.
ASKED = "queries AS (SELECT b.item_id AS query_id, b.text || ' src' || (b.item_id % 5) AS text, v.embedding AS embedding FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id)"
SOURCES = """nodes AS (SELECT DISTINCT source AS name, 'Concept' AS label FROM documents UNION ALL SELECT DISTINCT lang, 'Concept' FROM documents),
  edges AS (SELECT lang || '-' || source AS eid, lang AS subj, 'HAS' AS pred, source AS obj, CAST(NULL AS VARCHAR) AS status, 'documents' AS source, CAST(NULL AS TIMESTAMP) AS updated, CAST(NULL AS VARCHAR) AS superseded_by,
    'the corpus in ' || lang || ' from ' || source || ' has ' || count(*) || ' texts' AS ko_summary FROM documents GROUP BY lang, source)"""


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return A.recall_queries(spark, sf).withColumn("text", F.concat(F.col("text"), F.lit(" src"), (F.col("query_id") % 5).cast("string")))


def corpus_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = A.table(spark, sf, "documents")
    nodes = d.select(F.col("source").alias("name"), F.lit("Concept").alias("label")).distinct().unionByName(d.select(F.col("lang").alias("name"), F.lit("Concept").alias("label")).distinct())
    none = F.lit(None).cast("string")
    e = d.groupBy("lang", "source").agg(F.count("*").alias("n"))
    said = F.concat(F.lit("the corpus in "), "lang", F.lit(" from "), "source", F.lit(" has "), F.col("n").cast("string"), F.lit(" texts"))
    edges = e.select(F.concat("lang", F.lit("-"), "source").alias("eid"), F.col("lang").alias("subj"), F.lit("HAS").alias("pred"), F.col("source").alias("obj"), none.alias("status"), F.lit("documents").alias("source"), F.lit(None).cast("timestamp").alias("updated"), none.alias("superseded_by"), said.alias("ko_summary"))
    return nodes, edges


def number_model(spark: SparkSession, sf: str) -> R.TextModel:
    """A stand-in for an embedding model that SQL has too: a text's vector is that of its length, modulo 100."""
    vectors = A.table(spark, sf, "embeddings").select((F.col("vec_id")).alias("_n"), "embedding")
    return lambda texts: texts.withColumn("_n", (F.length("text") % 100).cast("long")).join(vectors, "_n").drop("_n")




def words(x: str) -> str:
    return f"list_distinct(list_transform({Q.tokens(x, [])}, lambda w: lower(w)))"


OVERLAP = f"CASE WHEN len({words('q.text')}) > 0 THEN round(len(list_intersect({words('q.text')}, {words('m.summary')})) / len({words('q.text')}), 4) ELSE 0.0 END"
NAMES = "names AS (SELECT query_id, list_sort(list(DISTINCT name)) AS names FROM found GROUP BY query_id)"
FUSED = f"""v1 AS ({Q.first_key("vec", "sim")}), b1 AS ({Q.first_key("(SELECT * FROM lex WHERE norm_score >= 0.62)", "norm_score")}),
  parts AS (SELECT query_id, fkey, 1.0 / (60 + rank) AS part, 0 AS ch, 'vec' AS name, pid FROM v1 UNION ALL SELECT query_id, fkey, 1.0 / (60 + rank), 1, 'bm25', pid FROM b1),
  rrf0 AS (SELECT query_id, fkey, round(sum(part) * 100, 6) AS fused, arg_min(pid, ch) AS pid, string_agg(name, ',' ORDER BY name) AS channels FROM parts GROUP BY ALL),
  boosted AS (SELECT r.*, m.ts, CASE WHEN len(list_intersect(m.entities, n.names)) > 0 OR len(list_filter(n.names, lambda x: contains(lower(m.summary), lower(x)))) > 0 THEN round(fused * 1.15, 6) ELSE fused END AS b
    FROM rrf0 r JOIN memories m USING (pid) LEFT JOIN names n ON n.query_id = r.query_id),
  rrf AS (SELECT query_id, fkey, pid, channels, {Q.decay('b')} AS sort_key FROM boosted)"""


def _best(channels: str) -> str:
    return f"""topped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sort_key DESC, fkey) AS r15 FROM {channels}) WHERE r15 <= 15),
  s AS (SELECT t.query_id, t.pid, t.fkey, t.channels, t.sort_key, {OVERLAP} AS rerank_score FROM topped t JOIN memories m USING (pid) JOIN queries q USING (query_id))
  SELECT query_id, pid, fkey, channels, sort_key, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fkey) AS rank FROM s WHERE rerank_score >= 0.1) WHERE rank <= 5"""


@query(f"WITH {Q.MEMORIES}, {ASKED}, {SOURCES}, {Q.dense(0.2)}, {Q.bm25()}, {FOUND}, {NAMES}, {FUSED}, {_best('rrf')}")
def recall_with_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal ranks, raised by the graph's entities that a query names, re-ranked by a model of (query, summary)."""
    out = R.recall(asked(spark, sf), A.memories(spark, sf), *corpus_graph(spark, sf), p=P_GRAPH, algorithm="rrf", model=R.overlap_reranker)
    return out.select("query_id", "rank", "pid", "fkey", "channels", "sort_key", "rerank_score")


#: Upper-layer records: every tenth document's vector, linked to the document of twice its number.
UPPERS = "uppers AS (SELECT 'u' || pid AS pid, CASE WHEN CAST(pid AS BIGINT) % 20 = 0 THEN 'L3' ELSE 'L2' END AS layer, embedding, entities, memory_type AS scenario_id, collection AS title, CAST(CAST(pid AS BIGINT) * 2 AS VARCHAR) AS l1 FROM memories WHERE CAST(pid AS BIGINT) % 10 = 0 AND embedding IS NOT NULL)"
UPPER_HITS = f"""uhits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, layer ORDER BY score DESC, pid) AS rank FROM
  (SELECT q.query_id, u.pid, u.layer, u.l1, u.entities, u.scenario_id, u.title, {Q.cosine("q.embedding", "u.embedding")} AS score FROM queries q, uppers u) WHERE score >= 0.1) WHERE rank <= 5)"""


def uppers(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("pid").cast("long")
    held = A.memories(spark, sf).filter((n % 10 == 0) & F.col("embedding").isNotNull())
    return held.select(F.concat(F.lit("u"), "pid").alias("pid"), F.when(n % 20 == 0, "L3").otherwise("L2").alias("layer"), "embedding", "entities", F.col("memory_type").alias("scenario_id"), F.col("collection").alias("title"), F.array((n * 2).cast("string")).alias("linked_l1_pids"))


@query(
    f"""WITH {Q.MEMORIES}, {Q.QUERIES}, {UPPERS}, {UPPER_HITS}, e AS (SELECT query_id, unnest(entities) AS x FROM uhits), s AS (SELECT query_id, unnest([scenario_id, title]) AS x FROM uhits WHERE layer = 'L2')
  SELECT h.query_id, n, (SELECT string_agg(DISTINCT x, '|' ORDER BY x) FROM e WHERE e.query_id = h.query_id) AS entities, coalesce((SELECT string_agg(DISTINCT x, '|' ORDER BY x) FROM s WHERE s.query_id = h.query_id), '') AS scenarios
  FROM (SELECT query_id, count(*) AS n FROM uhits GROUP BY query_id) h"""
)
def upper_context(spark: SparkSession, sf: str) -> DataFrame:
    """Entities and scenarios of each query's upper-layer hits."""
    hits, context = R.upper_context(A.recall_queries(spark, sf), uppers(spark, sf), P, floor=0.1)
    counted = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    return counted.join(context, "query_id").select("query_id", "n", F.array_join("entities", "|").alias("entities"), F.array_join("scenarios", "|").alias("scenarios"))


@query(
    f"""WITH {Q.MEMORIES}, {Q.QUERIES}, {UPPERS}, {UPPER_HITS}, {Q.dense(0.2)}, {Q.bm25()}, {Q.ARITHMETIC},
  links AS (SELECT query_id, l1, max(score) AS parent_score FROM uhits GROUP BY ALL),
  res0 AS (SELECT k.query_id, m.pid, {Q.fkey('m.summary')} AS fkey, greatest(k.parent_score, {Q.cosine("q.embedding", "m.embedding")}) AS sort_key, {Q.cosine("q.embedding", "m.embedding")} AS sim FROM links k JOIN memories m ON m.pid = k.l1 AND m.embedding IS NOT NULL JOIN queries q USING (query_id)),
  res AS (SELECT query_id, fkey, pid, 'upper' AS channels, sort_key FROM (SELECT *, row_number() OVER (PARTITION BY query_id, fkey ORDER BY sort_key DESC, pid) AS n FROM res0 r WHERE sim >= 0.0 AND fkey <> '' AND NOT EXISTS (SELECT 1 FROM arith a WHERE a.query_id = r.query_id AND a.fkey = r.fkey)) WHERE n = 1),
  everything AS (SELECT query_id, fkey, pid, channels, sort_key FROM arith UNION ALL SELECT query_id, fkey, pid, channels, sort_key FROM res), {_best('everything')}"""
)
def recall_with_uppers(spark: SparkSession, sf: str) -> DataFrame:
    """Arithmetic fusion, followed by the L1 records behind hits of the upper layers, re-ranked by a model."""
    p = P_GRAPH.with_(upper_floor=0.1, resolve_floor=0.0)
    out = R.recall(A.recall_queries(spark, sf), A.memories(spark, sf), p=p, model=R.overlap_reranker, uppers=uppers(spark, sf))
    return out.select("query_id", "rank", "pid", "fkey", "channels", "sort_key", "rerank_score")


NEAR = "near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, k) AS rank FROM (SELECT f.query_id, s.*, row_number() OVER (PARTITION BY f.query_id, src ORDER BY updated DESC NULLS LAST, dst, pred, s.summary) AS k FROM (SELECT DISTINCT query_id, name FROM found) f JOIN steps s ON s.src = f.name) WHERE k <= 4)"


@query(
    f"""WITH {ASKED}, {SOURCES}, {FOUND}, {STEPS}, {NEAR}
  SELECT n.query_id, n.src, n.dst, n.rank, coalesce({Q.cosine("q.embedding", "v.embedding")}, 0.0) AS graph_sim FROM near n JOIN queries q USING (query_id) LEFT JOIN embeddings v ON v.vec_id = length(n.summary) % 100"""
)
def graph_channel(spark: SparkSession, sf: str) -> DataFrame:
    """One hop from the entities of a query, with the similarity of each edge's text."""
    out = R.graph_channel(asked(spark, sf), *corpus_graph(spark, sf), P, model=number_model(spark, sf))
    return out.select("query_id", "src", "dst", "rank", "graph_sim")


@query(
    f"""WITH {Q.MEMORIES}, {ASKED}, {SOURCES}, {Q.dense(0.2)}, {Q.bm25()}, {FOUND}, {STEPS}, {NEAR},
  prf AS (SELECT query_id, string_agg(summary, ' ' ORDER BY rank) AS added FROM (SELECT n.query_id, n.summary, n.rank, row_number() OVER (PARTITION BY n.query_id ORDER BY n.rank) AS m FROM near n JOIN queries q USING (query_id)
    WHERE length(n.summary) >= 2 AND ((src <> '' AND contains(lower(q.text), lower(src))) OR (dst <> '' AND contains(lower(q.text), lower(dst))))) WHERE m <= 3 GROUP BY query_id),
  wider AS (SELECT query_id, v.embedding FROM (SELECT q.query_id, q.text || ' ' || p.added AS t FROM queries q JOIN prf p USING (query_id)) JOIN embeddings v ON v.vec_id = length(t) % 100),
  {Q.dense(0.2, queries='wider').replace('vec AS', 'vec2 AS', 1)},
  vecs AS (SELECT query_id, pid, rank FROM vec UNION ALL SELECT query_id, pid, rank + coalesce((SELECT max(rank) FROM vec v WHERE v.query_id = vec2.query_id), 0) FROM vec2),
  gch AS (SELECT query_id, summary, rank FROM near),
  {NCH.format(more=" UNION ALL SELECT query_id, summary, min(rank), 'graph' FROM gch GROUP BY ALL").replace("FROM vec JOIN", "FROM vecs JOIN")},
  gnames2 AS (SELECT query_id, list(DISTINCT x) AS names FROM (SELECT query_id, unnest([src, dst]) AS x FROM near) GROUP BY query_id),
  known AS (SELECT query_id, summary, arg_min(pid, o) AS pid, arg_min(struct_pack(i := importance, t := ts), o) AS r FROM (SELECT query_id, summary, pid, importance, ts, (c, rank, pid) AS o FROM
    (SELECT query_id, pid, rank, 0 AS c FROM vecs UNION ALL SELECT query_id, pid, rank, 1 FROM lex) JOIN memories USING (pid)) GROUP BY query_id, summary),
  boosted AS (SELECT f.query_id, f.summary, f.channels, f.score, k.pid, k.r.i AS importance, k.r.t AS ts, CASE WHEN contains(f.channels, 'graph') AND len(list_filter(coalesce(g.names, []), lambda x: x <> '' AND contains(lower(f.summary), lower(x)))) > 0 THEN round(f.score * 1.15, 4) ELSE f.score END AS b
    FROM nfused f LEFT JOIN known k ON k.query_id = f.query_id AND k.summary = f.summary LEFT JOIN gnames2 g ON g.query_id = f.query_id),
  posted AS (SELECT *, {Q.decay(Q.imp('b'))} AS s0 FROM boosted),
  verified AS (SELECT p.*, {Q.fkey('p.summary')} AS fkey, {Q.cosine("q.embedding", "v.embedding")} AS sim FROM posted p JOIN queries q USING (query_id) JOIN embeddings v ON v.vec_id = length(p.summary) % 100),
  best AS (SELECT * FROM (SELECT *, round(s0 * 0.39 + sim * 0.61, 4) AS sort_key FROM verified WHERE sim >= 0.0 AND fkey <> '') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sort_key DESC, fkey) <= 5),
  one AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(pid, 'key:' || fkey) ORDER BY sort_key DESC, fkey) = 1)
  SELECT query_id, pid, md5(summary) AS digest, channels, score, sort_key, sim, sim < 0.1 AS is_weak, row_number() OVER (PARTITION BY query_id ORDER BY sort_key DESC, fkey) AS rank FROM one
  WHERE contains(channels, 'vec') OR contains(channels, 'bm25') OR (length(summary) >= 6 AND len(regexp_split_to_array({Q.strip("summary")}, '\\s+')) > 3 AND NOT list_bool_or(list_transform(regexp_split_to_array({Q.strip("summary")}, '\\s+'), lambda w: length(w) > 3 AND w = upper(w) AND w <> lower(w))))"""
)
def legacy_recall_full(spark: SparkSession, sf: str) -> DataFrame:
    """The older preset as a whole: expansion by the graph and a second dense pass, boost, weights, verification against the query's vector."""
    p = P.with_(kg_weak=0.0, kg_strong=0.1)
    out = R.legacy_recall(asked(spark, sf), A.memories(spark, sf), *corpus_graph(spark, sf), p, model=number_model(spark, sf))
    return out.select("query_id", "pid", F.md5(F.col("summary").cast("binary")).alias("digest"), "channels", "score", "sort_key", "sim", "is_weak", "rank")
