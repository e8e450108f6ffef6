"""Queries over channels, fusion and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scoring as X
from palimpsest.operators import bm25, clusters, dense, fusion, graph
from palimpsest.params import DEFAULT
from palimpsest.plans import recall as R
from palimpsest.plans import sql as Q
from palimpsest.plans.catalog import query
from palimpsest.plans.text_queries import REASON
from palimpsest.sources import adapters as A

#: The fixture's vectors are nearly orthogonal, so its waterlines are lower than the defaults.
P = DEFAULT.with_(vec_floor=0.2, legacy_vec_floor=0.2, rerank_floor=0.1, resolve_floor=0.1, candidate_floor=0.2)
VECTORS = "vectors AS (SELECT CAST(vec_id AS VARCHAR) AS pid, CAST(label AS VARCHAR) AS collection, embedding FROM embeddings)"
ASKED = "queries AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0)"
BASE = f"{Q.MEMORIES}, {Q.QUERIES}"
CHANNELS = f"{BASE}, {Q.dense(0.2)}, {Q.bm25()}"


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = A.table(spark, sf, "embeddings")
    return v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").cast("string").alias("pid"), F.col("label").cast("string").alias("collection"), "embedding")


@query(f"WITH {VECTORS}, {ASKED}, {Q.dense(0.2, items='vectors')} SELECT query_id, pid, sim, rank FROM vec")
def vec_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.dense_top_k(*_vectors(spark, sf), 20, 0.2).select("query_id", "pid", "sim", "rank")


@query(
    f"""WITH {VECTORS}, {ASKED} SELECT * FROM (SELECT query_id, pid, collection, sim, row_number() OVER (PARTITION BY query_id, collection ORDER BY sim DESC, pid) AS rank
  FROM (SELECT q.query_id, m.pid, m.collection, {Q.cosine("q.embedding", "m.embedding")} AS sim FROM queries q, vectors m) WHERE sim >= 0.1) WHERE rank <= 3"""
)
def vec_topk_per_collection(spark: SparkSession, sf: str) -> DataFrame:
    return dense.dense_top_k(*_vectors(spark, sf), 3, 0.1, per="collection").select("query_id", "pid", "collection", "sim", "rank")


@query(f"WITH {VECTORS} SELECT a.pid AS a, b.pid AS b, {Q.cosine('a.embedding', 'b.embedding')} AS sim FROM vectors a, vectors b WHERE a.pid < b.pid AND {Q.cosine('a.embedding', 'b.embedding')} >= 0.4")
def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return dense.similar_pairs(_vectors(spark, sf)[1], 0.4)


@query(
    f"""WITH {VECTORS}, {ASKED}, {Q.dense(0.2, k=3, items='vectors')}
  SELECT query_id, count(*) AS candidates, max(sim) AS best FROM vec WHERE CAST(query_id AS VARCHAR) <> pid GROUP BY query_id"""
)
def dedup_candidates(spark: SparkSession, sf: str) -> DataFrame:
    hits = dense.dense_top_k(*_vectors(spark, sf), 3, 0.2).filter(F.col("query_id").cast("string") != F.col("pid"))
    return hits.groupBy("query_id").agg(F.count("*").alias("candidates"), F.max("sim").alias("best"))


@query(f"WITH {BASE}, {Q.bm25()} SELECT query_id, pid, raw, rank FROM lex")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.search(A.recall_queries(spark, sf), bm25.build(A.memories(spark, sf))).select("query_id", "pid", "raw", "rank")


@query(f"WITH {BASE}, {Q.bm25()} SELECT query_id, pid, norm_score FROM lex WHERE norm_score >= 0.62")
def bm25_norm_floor(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.search(A.recall_queries(spark, sf), bm25.build(A.memories(spark, sf)), floor=0.62).select("query_id", "pid", "norm_score")


@query(f"WITH {Q.MEMORIES}, tokens_ AS (SELECT pid, {Q.tokens('summary')} AS t FROM memories) SELECT term, count(DISTINCT pid) AS df FROM (SELECT pid, unnest(t) AS term FROM tokens_) GROUP BY term")
def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.build(A.memories(spark, sf)).terms


@query(f"WITH {CHANNELS} SELECT query_id, fkey, pid FROM ({Q.first_key('lex', 'norm_score')})")
def fusion_key_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.first_per_key(R.lexical_channel(A.recall_queries(spark, sf), A.memories(spark, sf), P)).select("query_id", "fkey", "pid")


def _channels(spark: SparkSession, sf: str, text: bool = False) -> tuple[DataFrame, DataFrame]:
    q, m = A.recall_queries(spark, sf), A.memories(spark, sf)
    index = R.items(m)
    return R.dense_channel(q, m, P, held=index.docs, text=text), R.lexical_channel(q, m, P, index, text=text)


@query(f"WITH {CHANNELS}, {Q.ARITHMETIC} SELECT query_id, fkey, pid, channels, fused, sort_key FROM arith")
def fuse_arith(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.arithmetic(*_channels(spark, sf), p=P).select("query_id", "fkey", "pid", "channels", "fused", "sort_key")


RRF = f"""v1 AS ({Q.first_key("vec", "sim")}), b1 AS ({Q.first_key("(SELECT * FROM lex WHERE norm_score >= 0.62)", "norm_score")}),
  parts AS (SELECT query_id, fkey, 1.0 / (60 + rank) AS part, 0 AS ch, 'vec' AS name, pid, ts FROM v1 UNION ALL SELECT query_id, fkey, 1.0 / (60 + rank), 1, 'bm25', pid, ts FROM b1),
  rrf0 AS (SELECT query_id, fkey, round(sum(part) * 100, 6) AS fused, arg_min(pid, ch) AS pid, string_agg(name, ',' ORDER BY name) AS channels FROM parts GROUP BY ALL),
  rrf AS (SELECT r.*, m.ts, m.summary, m.entities FROM rrf0 r JOIN memories m USING (pid))"""


@query(f"WITH {CHANNELS}, {RRF} SELECT query_id, fkey, pid, channels, fused, {Q.decay('fused')} AS sort_key FROM rrf")
def fuse_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rrf(*_channels(spark, sf), p=P).select("query_id", "fkey", "pid", "channels", "fused", "sort_key")


@query(f"WITH {CHANNELS}, {RRF} SELECT query_id, fkey, {Q.decay('b')} AS sort_key FROM (SELECT *, CASE WHEN contains(lower(summary), 'the') OR list_contains(entities, 'src1') THEN round(fused * 1.15, 6) ELSE fused END AS b FROM rrf)")
def fuse_rrf_entities(spark: SparkSession, sf: str) -> DataFrame:
    names = A.recall_queries(spark, sf).select("query_id", F.array(F.lit("The"), F.lit("src1")).alias("names"))
    return fusion.rrf(*_channels(spark, sf, text=True), names, P).select("query_id", "fkey", "sort_key")


NCH = """np AS (SELECT query_id, summary, min(rank) AS rank, 'vec' AS c FROM vec JOIN memories USING (pid) GROUP BY ALL UNION ALL SELECT query_id, summary, min(rank), 'bm25' FROM lex JOIN memories USING (pid) GROUP BY ALL{more}),
  nsum AS (SELECT query_id, summary, sum(1.0 / (60 + rank)) AS s, string_agg(c, ',' ORDER BY c) AS channels FROM np GROUP BY ALL),
  nfused AS (SELECT query_id, summary, channels, round(s / max(s) OVER (PARTITION BY query_id), 4) AS score FROM nsum)"""


@query(f"WITH {CHANNELS}, {NCH.format(more='')} SELECT query_id, md5(summary) AS digest, channels, score FROM nfused")
def fuse_rrf_nchannel(spark: SparkSession, sf: str) -> DataFrame:
    vec, lex = _channels(spark, sf, text=True)
    return fusion.rrf_n({"vec": vec, "bm25": lex}).select("query_id", F.md5(F.col("summary").cast("binary")).alias("digest"), "channels", "score")


SCORE = "WITH {m}, s AS (SELECT *, round((CAST(pid AS BIGINT) % 100) / 100.0, 4) AS score FROM memories)".format(m=Q.MEMORIES)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return A.memories(spark, sf).withColumn("score", F.round((F.col("pid").cast("long") % 100) / 100.0, 4))


@query(f"{SCORE} SELECT pid, {Q.imp('score')} AS weighted, round(score * (0.5 + greatest(0, least(1, importance))), 4) AS documented FROM s")
def importance_weight(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("pid", X.importance_weight(F.col("score"), F.col("importance")).alias("weighted"), X.importance_weight_plain(F.col("score"), F.col("importance")).alias("documented"))


@query(f"{SCORE} SELECT pid, {Q.decay('score')} AS decayed, CASE WHEN ts IS NULL THEN score ELSE round(score * power(0.5, {Q.days('ts')} / 180.0), 4) END AS documented FROM s")
def time_decay(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("pid", X.time_decay(F.col("score"), F.col("ts")).alias("decayed"), X.time_decay_half_life(F.col("score"), F.col("ts")).alias("documented"))


@query(f"{SCORE} SELECT pid, CASE WHEN score >= 0.99 THEN round(1.0 / (1 + greatest(0, CAST(pid AS BIGINT) % 7 - 1)), 4) ELSE score END AS depth_score, CAST(greatest(0.1, 1 - 0.2 * (CAST(pid AS BIGINT) % 7)) AS DOUBLE) AS rank_score FROM s")
def graph_depth_score(spark: SparkSession, sf: str) -> DataFrame:
    depth = F.col("pid").cast("long") % 7
    return _scored(spark, sf).select("pid", X.depth_score(F.col("score"), depth).alias("depth_score"), X.rank_score(depth + 1).alias("rank_score"))


ASSOC = f"round(0.4 * o + 0.25 * power(0.5, hop - 1) + 0.2 * greatest(0, least(1, importance)) + 0.15 * CASE WHEN ts IS NULL THEN 1.0 ELSE greatest(0.5, 1 - {Q.days('ts')} / 540.0) END, 4)"


@query(f"{SCORE} SELECT pid, hop, {ASSOC} AS assoc_score FROM (SELECT *, CAST(pid AS BIGINT) % 3 + 1 AS hop, len(list_intersect(entities, ['en', 'src1'])) / 2.0 AS o FROM s) WHERE NOT (o < 0.1 AND hop > 1)")
def assoc_score(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf).withColumns({"hop": F.col("pid").cast("long") % 3 + 1, "o": X.overlap_ratio(F.array(F.lit("en"), F.lit("src1")), F.col("entities"))})
    return s.filter(X.activated(F.col("o"), F.col("hop"))).select("pid", "hop", X.association_score(F.col("o"), F.col("hop"), F.col("importance"), F.col("ts")).alias("assoc_score"))


@query(f"WITH {CHANNELS}, {NCH.format(more='')} SELECT query_id, md5(summary) AS digest, CASE WHEN contains(channels, 'vec') AND contains(lower(summary), 'the') THEN round(score * 1.15, 4) ELSE score END AS boosted FROM nfused")
def graph_boost(spark: SparkSession, sf: str) -> DataFrame:
    vec, lex = _channels(spark, sf, text=True)
    f = fusion.rrf_n({"vec": vec, "bm25": lex}).withColumn("channels", F.regexp_replace("channels", "vec", "graph")).withColumnRenamed("score", "sort_key")
    names = A.recall_queries(spark, sf).select("query_id", F.array(F.lit("THE")).alias("names"))
    return fusion.graph_boosted(f, names).select("query_id", F.md5(F.col("summary").cast("binary")).alias("digest"), F.col("sort_key").alias("boosted"))


@query(
    f"""WITH {CHANNELS}, {Q.ARITHMETIC}, k AS (SELECT a.query_id, a.fkey, round(a.sort_key * 0.39 + v.sim * 0.61, 4) AS sort_key, v.sim < 0.25 AS is_weak FROM arith a JOIN vec v ON a.query_id = v.query_id AND a.pid = v.pid WHERE v.sim >= 0.22)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sort_key DESC, fkey) AS rank FROM k) WHERE rank <= 5"""
)
def kg_verify(spark: SparkSession, sf: str) -> DataFrame:
    vec, lex = _channels(spark, sf)
    items = fusion.arithmetic(vec, lex, p=P).join(vec.select("query_id", "pid", F.col("score").alias("sim")), ["query_id", "pid"])
    return fusion.kg_verified(items.select("query_id", "fkey", "sort_key", "sim"), P.with_(kg_weak=0.22, kg_strong=0.25)).select("query_id", "fkey", "sort_key", "is_weak", "rank")


@query(
    f"""WITH {BASE}, {Q.bm25()}, r AS (SELECT query_id, pid, norm_score AS score, summary, row_number() OVER (PARTITION BY query_id ORDER BY norm_score DESC, pid) AS n, count(*) OVER (PARTITION BY query_id) AS c FROM lex JOIN memories USING (pid)),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n > 3, CASE WHEN n > 3 THEN NOT contains(summary, 'that') ELSE false END, n) AS m FROM r) SELECT query_id, pid FROM o WHERE m <= greatest(3, CAST(floor(c * 0.5) AS INT))"""
)
def keyword_soft_filter(spark: SparkSession, sf: str) -> DataFrame:
    lex = R.lexical_channel(A.recall_queries(spark, sf), A.memories(spark, sf), P, text=True)
    return fusion.keyword_filter(lex, F.contains(F.col("summary"), F.lit("that")), 3, 0.5).select("query_id", "pid")


GATED = f"queries AS (SELECT * FROM (SELECT *, {REASON} AS reason FROM (SELECT *, {Q.strip('text')} AS s FROM ({Q.QUERIES.removeprefix('queries AS (')})) WHERE reason = '')"
TOPPED = "topped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sort_key DESC, fkey) AS r15 FROM arith) WHERE r15 <= 15)"


@query(
    f"""WITH {CHANNELS.replace(Q.QUERIES, GATED)}, {Q.ARITHMETIC}, {TOPPED}, s AS (SELECT *, round(least(1.0, greatest(0.0, sort_key)), 4) AS rerank_score FROM topped)
  SELECT query_id, pid, fkey, channels, sort_key, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fkey) AS rank FROM s WHERE rerank_score >= 0.1) WHERE rank <= 5"""
)
def hybrid_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: gate, dense and lexical channels, fusion, re-rank, cut."""
    return R.recall(A.recall_queries(spark, sf), A.memories(spark, sf), p=P).select("query_id", "rank", "pid", "fkey", "channels", "sort_key", "rerank_score")


FOUND = f"""gnames AS (SELECT DISTINCT name AS pid, name AS summary FROM nodes), {Q.bm25(k=50, items="gnames", name="ent", stop=[])},
  ent1 AS (SELECT query_id, pid AS name, raw FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(pid) ORDER BY raw DESC, pid) AS d FROM ent) WHERE d = 1),
  found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, name) AS n FROM ent1) WHERE n <= 5)"""
STEPS = f"""steps AS (SELECT src, dst, pred, summary, max(updated) AS updated FROM (SELECT subj AS src, obj AS dst, pred, coalesce(nullif(ko_summary, ''), subj || ' ' || pred || ' ' || obj) AS summary, updated FROM edges WHERE {Q.ACTIVE}
  UNION ALL SELECT obj, subj, pred, coalesce(nullif(ko_summary, ''), subj || ' ' || pred || ' ' || obj), updated FROM edges WHERE {Q.ACTIVE}) GROUP BY ALL)"""
#: Queries that name customers and parts, for the graph side.
NAMED = "queries AS (SELECT n_nationkey AS query_id, n_name || ' ' || r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey)"


def named_queries(spark: SparkSession, sf: str) -> DataFrame:
    n, r = A.table(spark, sf, "nation"), A.table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("query_id"), F.concat_ws(" ", "n_name", "r_name").alias("text"))


@query(f"WITH {Q.NODES}, {NAMED}, {FOUND} SELECT query_id, name, raw, n FROM found")
def entity_search(spark: SparkSession, sf: str) -> DataFrame:
    return graph.entity_search(named_queries(spark, sf), A.nodes(spark, sf))


@query(
    f"""WITH {Q.MEMORIES}, {Q.NODES}, {Q.EDGES}, queries AS (SELECT n_nationkey AS query_id, n_name || ' ' || r_name AS text, v.embedding FROM nation JOIN region ON n_regionkey = r_regionkey JOIN embeddings v ON v.vec_id = n_nationkey),
  {Q.dense(0.2)}, {Q.bm25()}, {FOUND}, {STEPS},
  near AS (SELECT * FROM (SELECT f.query_id, s.*, row_number() OVER (PARTITION BY f.query_id, src ORDER BY updated DESC NULLS LAST, dst, pred, s.summary) AS k FROM (SELECT DISTINCT query_id, name FROM found) f JOIN steps s ON s.src = f.name) WHERE k <= 4),
  gch AS (SELECT query_id, summary, row_number() OVER (PARTITION BY query_id ORDER BY src, k) AS rank FROM near WHERE length(summary) >= 6 AND len(regexp_split_to_array({Q.strip("summary")}, '\\s+')) > 3
    AND NOT list_bool_or(list_transform(regexp_split_to_array({Q.strip("summary")}, '\\s+'), lambda w: length(w) > 3 AND w = upper(w) AND w <> lower(w)))),
  {NCH.format(more=" UNION ALL SELECT query_id, summary, min(rank), 'graph' FROM gch GROUP BY ALL")} SELECT query_id, md5(summary) AS digest, channels, score FROM nfused"""
)
def legacy_recall(spark: SparkSession, sf: str) -> DataFrame:
    q = named_queries(spark, sf).join(A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    out = R.legacy_recall(q, A.memories(spark, sf), A.nodes(spark, sf), A.edges(spark, sf), P)
    return out.select("query_id", F.md5(F.col("summary").cast("binary")).alias("digest"), "channels", "score")


@query(
    f"""WITH {BASE}, {Q.dense(0.2)}, up AS (SELECT pid, [pid, CAST(CAST(pid AS BIGINT) + 1 AS VARCHAR)] AS l FROM memories),
  links AS (SELECT query_id, l1, max(sim) AS parent_score FROM (SELECT query_id, sim, unnest(l) AS l1 FROM vec JOIN up USING (pid)) GROUP BY ALL)
  SELECT * FROM (SELECT k.query_id, k.l1 AS pid, k.parent_score, {Q.cosine("q.embedding", "m.embedding")} AS sim FROM links k JOIN memories m ON m.pid = k.l1 AND m.embedding IS NOT NULL JOIN queries q USING (query_id)) WHERE sim >= 0.1"""
)
def resolve_l1(spark: SparkSession, sf: str) -> DataFrame:
    q, m = A.recall_queries(spark, sf), A.memories(spark, sf)
    hits = dense.dense_top_k(q, m, 20, 0.2).select("query_id", "pid", F.col("sim").alias("score"))
    uppers = m.select("pid", F.array(F.col("pid"), (F.col("pid").cast("long") + 1).cast("string")).alias("linked_l1_pids"))
    return R.resolve_to_l1(hits, uppers, m, q, P)


@query(
    f"""WITH {Q.EDGES}, {NAMED}, s AS (SELECT DISTINCT unnest([subj, obj]) AS name, coalesce(nullif(ko_summary, ''), subj || ' ' || pred || ' ' || obj) AS summary FROM edges WHERE {Q.ACTIVE}),
  h AS (SELECT DISTINCT query_id, summary FROM queries JOIN s ON contains(lower(text), lower(name))), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY summary) AS n FROM h)
  SELECT q.query_id, concat_ws(' ', q.text, (SELECT string_agg(summary, ' ' ORDER BY n) FROM t WHERE t.query_id = q.query_id AND n <= 3)) AS text FROM queries q"""
)
def prf_expand(spark: SparkSession, sf: str) -> DataFrame:
    return R.prf_expanded(named_queries(spark, sf), A.edges(spark, sf))


@query(f"WITH {VECTORS}, p AS (SELECT a.pid AS a, b.pid AS b FROM vectors a, vectors b WHERE a.pid <> b.pid AND {Q.cosine('a.embedding', 'b.embedding')} >= 0.4) SELECT a AS pid, least(min(a), min(b)) AS nearest FROM p GROUP BY a")
def dup_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    p = dense.similar_pairs(_vectors(spark, sf)[1], 0.4)
    both = p.select("a", "b").unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("nearest")).withColumnRenamed("a", "pid")


@query(
    f"""WITH RECURSIVE {VECTORS}, e AS (SELECT a.pid AS a, b.pid AS b FROM vectors a, vectors b WHERE a.pid <> b.pid AND {Q.cosine('a.embedding', 'b.embedding')} >= 0.4),
  reach(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), g AS (SELECT a AS pid, min(b) AS label FROM reach GROUP BY a), {Q.MEMORIES}
  SELECT label, pid FROM (SELECT g.*, row_number() OVER (PARTITION BY label ORDER BY importance DESC, length(summary) DESC, g.pid) AS n FROM g JOIN memories m ON m.pid = g.pid) WHERE n = 1"""
)
def dedup_keep_best(spark: SparkSession, sf: str) -> DataFrame:
    groups = clusters.connected(dense.similar_pairs(_vectors(spark, sf)[1], 0.4))
    return clusters.keep_best(groups, A.memories(spark, sf), "label").select("label", "pid")


ACTION = """CASE WHEN state = 'uncertain' AND best IS NULL THEN 'DISCARD' WHEN state = 'uncertain' THEN 'INVALIDATE' WHEN best IS NULL THEN 'CREATE' WHEN state = 'historical' THEN 'UPDATE' WHEN best >= 0.82 THEN 'SKIP' WHEN best >= 0.80 THEN 'UPDATE' ELSE 'CREATE' END"""
STATES = "d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'historical' ELSE 'active' END AS state, CASE WHEN doc_id % 3 > 0 THEN round(0.7 + (doc_id % 30) / 100.0, 4) END AS best FROM documents)"


def _states(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return A.table(spark, sf, "documents").select("doc_id", F.when(d % 5 == 0, "uncertain").when(d % 5 == 1, "historical").otherwise("active").alias("state"), F.when(d % 3 > 0, F.round(0.7 + (d % 30) / 100.0, 4)).alias("best"))


@query(f"WITH {STATES} SELECT doc_id, {ACTION} AS action FROM d")
def dedup_decision_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf).select("doc_id", X.dedup_action(F.col("state"), F.col("best")).alias("action"))


@query(f"WITH {STATES} SELECT doc_id, CASE WHEN state = 'uncertain' AND best IS NULL THEN 'DISCARD' WHEN state = 'uncertain' THEN 'INVALIDATE' ELSE 'CREATE' END AS action FROM d")
def dedup_decision_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf).select("doc_id", X.dedup_fallback(F.col("state"), F.col("best").isNotNull()).alias("action"))


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || turn || '-' || role AS pid, CASE WHEN row_number() OVER (PARTITION BY trim(text) ORDER BY conv_id, turn, role) > 1 THEN 'SKIP' ELSE 'CREATE' END AS action FROM conversations")
def dedup_decision_literal(spark: SparkSession, sf: str) -> DataFrame:
    """L0 only: a text that an earlier record has is skipped. Texts meet by digest."""
    c = A.table(spark, sf, "conversations").withColumn("pid", F.concat_ws("-", "conv_id", "turn", "role"))
    first = c.groupBy(F.md5(F.trim("text").cast("binary")).alias("h")).agg(F.min(F.struct("conv_id", "turn", "role")).alias("f"))
    return c.withColumn("h", F.md5(F.trim("text").cast("binary"))).join(first, "h").select("pid", F.when(F.struct("conv_id", "turn", "role") == F.col("f"), "CREATE").otherwise("SKIP").alias("action"))
