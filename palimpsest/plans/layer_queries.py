"""Queries over the four-layer write, batch writes, graph upserts and changes by query."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import layers
from palimpsest.plans import sql as Q
from palimpsest.plans.catalog import query
from palimpsest.plans.recall_queries import number_model
from palimpsest.plans.search_queries import VECTORS, P
from palimpsest.sources import adapters as A

NOW = datetime(2024, 1, 31)
#: Every conversation turn is a bundle; the texts of every third conversation are there already.
BUNDLES = """bundles AS (SELECT conv_id || '-' || turn || '-' || role AS bundle_id, conv_id, role, text, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM conversations),
  old AS (SELECT s, min('old' || bundle_id) AS pid FROM bundles WHERE conv_id % 3 = 0 AND s <> '' GROUP BY s),
  decided AS (SELECT b.*, CASE WHEN o.pid IS NOT NULL THEN o.pid WHEN bundle_id <> min(bundle_id) OVER (PARTITION BY b.s) THEN min(bundle_id) OVER (PARTITION BY b.s) END AS match_pid FROM bundles b LEFT JOIN old o ON o.s = b.s WHERE b.s <> ''),
  going AS (SELECT * FROM bundles WHERE bundle_id NOT IN (SELECT bundle_id FROM decided WHERE match_pid IS NOT NULL))"""
NONE = "CAST(NULL AS VARCHAR)"


def hexnum(x: str, digits: int) -> str:
    return f"('0x' || substr(md5({x}), 1, {digits}))::UBIGINT::VARCHAR"


FACT = hexnum("'qdrant-v6|' || array_to_string(list_sort([role, 'c' || conv_id]), '::') || '||' || role || '|LIKES|c' || conv_id", 16)
IDS = f"""ids AS (SELECT *, {hexnum("'4layer|L0|' || bundle_id || '|' || s", 15)} AS p0, {FACT} AS p1, 'c' || conv_id AS sid, {hexnum("'4layer|L2|c' || conv_id", 15)} AS p2, {hexnum("'4layer|L3|' || role", 15)} AS p3 FROM going)"""


def _bundles(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn", "role").alias("bundle_id"), "conv_id", "role", "text")


def _written(spark: SparkSession, sf: str) -> layers.Written:
    b, none = _bundles(spark, sf), F.lit(None).cast("string")
    ent = lambda c, label: F.struct(c.alias("name"), F.lit(label).alias("label"))
    conv = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    times = F.struct(*[none.alias(n) for n in ("start", "end", "expression", "precision")]).alias("event_time"), F.struct(*[none.alias(n) for n in ("start", "end", "end_type")]).alias("valid_time")
    tags = F.array(F.lit("t")).alias("tags")
    l0 = b.select("bundle_id", F.col("text").alias("scene_summary"), F.col("role").alias("source"))
    rel = F.array(F.struct(F.col("role").alias("subject"), F.lit("LIKES").alias("predicate"), conv.alias("object"), none.alias("status")))
    kos = b.select("bundle_id", F.lit(0).alias("pos"), F.lit("fact").alias("type"), F.col("text").alias("summary"), none.alias("state"), F.array(ent(F.col("role"), "Person"), ent(conv, "Event")).alias("entities"), rel.alias("relations"), tags, F.lit(0.4).alias("importance"), *times)
    scenarios = b.select("bundle_id", conv.alias("title"), F.substring("text", 1, 60).alias("summary"), F.lit("event").alias("type"), none.alias("state"), F.lit(None).cast("double").alias("importance"), tags, F.array(ent(F.col("role"), "Person")).alias("entities"))
    personas = b.select("bundle_id", F.col("role").alias("summary"), F.lit("fact").alias("type"), none.alias("state"), F.lit(None).cast("double").alias("importance"), tags)
    old = b.filter("conv_id % 3 = 0").select(F.concat(F.lit("old"), "bundle_id").alias("pid"), F.lit("L0").alias("layer"), F.lit("memory_l0").alias("collection"), F.col("text").alias("summary"))
    return layers.write_layers(l0, kos, scenarios, personas, old, NOW, P)


@query(f"WITH {BUNDLES} SELECT bundle_id AS key, CASE WHEN match_pid IS NULL THEN 'CREATE' ELSE 'SKIP' END AS action, match_pid FROM decided")
def write_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Which conversations are new: equal texts meet, there or earlier in the batch."""
    return _written(spark, sf).decisions.select("key", "action", "match_pid")


@query(
    f"""WITH {BUNDLES}, {IDS} SELECT bundle_id, 'L0' AS layer, p0 AS pid, md5(s) AS digest, {NONE} AS scenario_id, {NONE} AS state, CAST(NULL AS DOUBLE) AS importance, len(list_filter([s], lambda x: x <> '')) AS n_links FROM ids WHERE s <> ''
  UNION ALL SELECT bundle_id, 'L1', p1, md5(text), NULL, NULL, 0.4, -1 FROM ids WHERE s <> ''
  UNION ALL SELECT bundle_id, 'L2', p2, md5(CASE WHEN {Q.strip('substr(text, 1, 60)')} <> '' THEN {Q.strip('substr(text, 1, 60)')} ELSE sid END), sid, 'historical', 0.7, CASE WHEN s <> '' THEN 1 ELSE 0 END FROM ids
  UNION ALL SELECT bundle_id, 'L3', p3, md5(role), NULL, 'active', 0.8, CASE WHEN s <> '' THEN 1 ELSE 0 END FROM ids"""
)
def write_layers(spark: SparkSession, sf: str) -> DataFrame:
    """The records of all four layers."""
    r = _written(spark, sf).records
    return r.select("bundle_id", "layer", "pid", F.md5(F.col("summary").cast("binary")).alias("digest"), "scenario_id", "state", "importance", F.when(F.col("layer") == "L1", -1).otherwise(F.size("linked_l1_pids")).alias("n_links"))


@query(
    f"""WITH {BUNDLES}, {IDS}, x AS (SELECT * FROM ids WHERE s <> '') SELECT DISTINCT * FROM (SELECT 'L0' AS src_layer, p0 AS src_id, 'L0_GENERATED' AS rel, 'L1' AS dst_layer, p1 AS dst_id FROM x UNION ALL SELECT 'L0', p0, 'GENERATED', 'entity', role FROM x
  UNION ALL SELECT 'L1', p1, 'BELONGS_TO', 'L2', sid FROM x UNION ALL SELECT 'L2', sid, 'INVOLVES', 'entity', role FROM ids UNION ALL SELECT 'L1', p1, 'DESCRIBES', 'L3', p3 FROM x)"""
)
def write_links(spark: SparkSession, sf: str) -> DataFrame:
    """The links between layers and entities."""
    return _written(spark, sf).links


@query(
    f"""WITH {BUNDLES}, {IDS} SELECT 'create' AS action, count(*) FILTER (s <> '') AS n FROM ids UNION ALL SELECT 'skipped', count(*) FROM decided WHERE match_pid IS NOT NULL UNION ALL SELECT unnest(['update', 'override', 'errors']), 0"""
)
def write_report(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, sf).report


@query(
    f"""WITH {BUNDLES}, d AS (SELECT CASE WHEN match_pid IS NULL THEN 'CREATE' ELSE 'SKIP' END AS action, CASE WHEN match_pid IS NULL THEN 'new text' ELSE 'equal text' END AS reason, md5(substr(text, 1, 120)) AS digest, CASE WHEN match_pid IS NULL THEN 0 ELSE 1 END AS n_candidates FROM decided)
  SELECT action, reason, digest, n_candidates, count(*) AS n FROM d GROUP BY ALL"""
)
def decision_log(spark: SparkSession, sf: str) -> DataFrame:
    b = _bundles(spark, sf)
    log = layers.decision_log(_written(spark, sf).decisions, b.select(F.col("bundle_id").alias("key"), F.col("text").alias("summary")), NOW)
    return log.groupBy("action", "reason", F.md5(F.col("summary").cast("binary")).alias("digest"), "n_candidates").agg(F.count("*").alias("n"))


BEST = f"pairs AS (SELECT a.pid AS key, b.pid AS pid, {Q.cosine('a.embedding', 'b.embedding')} AS sim FROM vectors a, vectors b WHERE CAST(a.pid AS BIGINT) % 20 = 0 AND CAST(b.pid AS BIGINT) % 20 > 0)"
STATE = "CASE CAST({k} AS BIGINT) % 3 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'historical' END"


@query(
    f"""WITH {VECTORS}, {BEST}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sim DESC, pid) AS r FROM pairs WHERE sim >= 0.3) WHERE r <= 5),
  b AS (SELECT key, max(sim) AS best, arg_min(pid, r) AS match_pid, count(*) AS n_candidates FROM c GROUP BY key), s AS (SELECT pid AS key, coalesce({STATE.format(k='pid')}, 'active') AS state FROM vectors WHERE CAST(pid AS BIGINT) % 20 = 0)
  SELECT key, match_pid, coalesce(n_candidates, 0) AS n_candidates, CASE WHEN state = 'uncertain' AND best IS NULL THEN 'DISCARD' WHEN state = 'uncertain' THEN 'INVALIDATE' WHEN best IS NULL THEN 'CREATE' WHEN state = 'historical' THEN 'UPDATE' WHEN best >= 0.45 THEN 'SKIP' WHEN best >= 0.4 THEN 'UPDATE' ELSE 'CREATE' END AS action,
  CASE WHEN state = 'uncertain' AND match_pid IS NULL THEN 'DISCARD' WHEN state = 'uncertain' THEN 'INVALIDATE' ELSE 'CREATE' END AS fallback FROM s LEFT JOIN b USING (key)"""
)
def layer_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Threshold decisions on records of any layer, and those without thresholds, by their nearest existing records."""
    v = A.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("pid"), "embedding", F.col("vec_id"))
    state = F.when(F.col("vec_id") % 3 == 0, "uncertain").when(F.col("vec_id") % 3 == 1, "historical")
    new, old = v.filter("vec_id % 20 = 0").select(F.col("pid").alias("key"), state.alias("state"), "embedding"), v.filter("vec_id % 20 > 0").select("pid", "embedding")
    p = P.with_(candidate_floor=0.3, dedup_skip=0.45, dedup_update=0.4)
    plain = layers.judged_decisions(new, old, None, p).select("key", F.col("action").alias("fallback"))
    return layers.threshold_decisions(new, old, p).join(plain, "key")


@query(
    """WITH base AS (SELECT n_name AS subj, 'VISITED' AS pred, r_name AS obj, 'active' AS status, 'geo' AS source FROM nation JOIN region ON n_regionkey = r_regionkey),
  fresh AS (SELECT subj, pred, obj, max((status, source)) AS v FROM (SELECT n_name AS subj, 'VISITED' AS pred, r_name AS obj, 'active' AS status, 'again' AS source FROM nation, region WHERE n_nationkey % 3 = 0 UNION ALL SELECT s_name, 'MENTIONED_IN', n_name, 'gone', '' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0) GROUP BY subj, pred, obj)
  SELECT coalesce(b.subj, f.subj) AS subj, coalesce(b.pred, f.pred) AS pred, coalesce(b.obj, f.obj) AS obj, CASE WHEN f.v IS NULL THEN b.status ELSE f.v[1] END AS status, CASE WHEN f.v IS NULL THEN b.source ELSE f.v[2] END AS source, b.subj IS NULL AS is_new, f.v IS NOT NULL AS changed
  FROM base b FULL JOIN fresh f ON b.subj = f.subj AND b.pred = f.pred AND b.obj = f.obj"""
)
def graph_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Edges merged into those that exist; suppliers of odd numbers are no nodes, so their edges cannot be."""
    n, r, s = (A.table(spark, sf, t) for t in ("nation", "region", "supplier"))
    old_time = F.lit("2020-01-01 00:00:00").cast("timestamp")
    edges = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("subj"), F.lit("VISITED").alias("pred"), F.col("r_name").alias("obj"), F.lit("active").alias("status"), F.lit("geo").alias("source"), old_time.alias("created"), old_time.alias("updated"))
    place = lambda df, c: df.select(F.col(c).alias("name"), F.lit("Place").alias("label"))
    nodes = place(n, "n_name").unionByName(place(r, "r_name")).withColumn("updated", old_time)
    again = n.filter("n_nationkey % 3 = 0").crossJoin(F.broadcast(r)).select(F.col("n_name").alias("subj"), F.lit("visited").alias("pred"), F.col("r_name").alias("obj"), F.lit(None).cast("string").alias("status"), F.lit("again").alias("source"))
    odd = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("subj"), F.lit("sits in").alias("pred"), F.col("n_name").alias("obj"), F.lit("gone").alias("status"), F.lit(None).cast("string").alias("source"))
    _, out = layers.upsert_graph(nodes, edges, place(s.filter("s_suppkey % 2 = 0"), "s_name"), again.unionByName(odd), NOW)
    return out.select("subj", "pred", "obj", "status", "source", (F.col("created") == F.lit(NOW)).alias("is_new"), (F.col("updated") == F.lit(NOW)).alias("changed"))


@query(
    """WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS pid, text AS summary, doc_id % 4 = 0 AS hit FROM documents)
  SELECT pid, md5(CASE WHEN hit THEN 'new ' || pid ELSE summary END) AS digest, CASE WHEN hit THEN md5(substr(summary, 1, 200)) END AS supersedes, CAST(NULL AS VARCHAR) AS superseded_by FROM m
  UNION ALL SELECT pid || '_hist_' || substr(md5('new ' || pid), 1, 8), md5(summary), NULL, 'new ' || pid FROM m WHERE hit"""
)
def override_records(spark: SparkSession, sf: str) -> DataFrame:
    """Replaced records with what they supersede, and the history beside them."""
    m = A.memories(spark, sf).select("pid", "summary", "ts")
    none = F.lit(None).cast("string")
    rel = F.array(F.struct(F.lit("a").alias("subject"), F.lit("LIKES").alias("predicate"), F.lit("b").alias("object"), none.alias("status")))
    new = m.filter(F.col("pid").cast("long") % 4 == 0).select("pid", F.concat(F.lit("new "), "pid").alias("summary"), rel.alias("relations"))
    edges = spark.createDataFrame([], "eid string, subj string, pred string, obj string, status string, superseded_by string, ko_summary string, updated timestamp")
    out, _ = layers.override(m, edges, new, NOW)
    return out.select("pid", F.md5(F.col("summary").cast("binary")).alias("digest"), F.when(F.col("supersedes").isNotNull(), F.md5(F.col("supersedes.summary").cast("binary"))).alias("supersedes"), "superseded_by")


SAID = "CASE doc_id % 6 WHEN 0 THEN 'SKIP' WHEN 1 THEN 'DISCARD' WHEN 2 THEN 'INVALIDATE' WHEN 3 THEN 'UPDATE' WHEN 4 THEN 'WHAT' END"


@query(
    f"""WITH d AS (SELECT doc_id AS key, {hexnum("'qdrant-v6|' || array_to_string(list_sort([lang, source]), '::') || '||' || lang || '|LIKES|' || source", 16)} AS pid, {SAID} AS said, lang FROM documents WHERE {Q.strip('text')} <> '')
  SELECT key, pid, CASE WHEN said IN ('SKIP', 'DISCARD', 'INVALIDATE') THEN 'skipped' WHEN lang = 'en' THEN 'update' ELSE 'create' END AS action FROM d"""
)
def batch_write(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of records dispatched by their decisions; identities that exist are updates."""
    d, none = A.table(spark, sf, "documents"), F.lit(None).cast("string")
    ent = lambda c: F.struct(F.col(c).alias("name"), F.lit("Concept").alias("label"))
    rel = F.array(F.struct(F.col("lang").alias("subject"), F.lit("LIKES").alias("predicate"), F.col("source").alias("object"), none.alias("status")))
    times = F.struct(*[none.alias(n) for n in ("start", "end", "expression", "precision")]).alias("event_time"), F.struct(*[none.alias(n) for n in ("start", "end", "end_type")]).alias("valid_time")
    kos = d.select(F.col("doc_id").alias("key"), F.lit("fact").alias("type"), F.col("text").alias("summary"), F.array(ent("lang"), ent("source")).alias("entities"), rel.alias("relations"), F.lit(0.5).alias("importance"), *times)
    existing = layers.l1_records(kos.filter("entities[0].name = 'en'"), None, "x").select("pid", "collection").distinct()
    k = F.col("doc_id") % 6
    decisions = d.filter(k != 5).select(F.col("doc_id").alias("key"), F.when(k == 0, "SKIP").when(k == 1, "DISCARD").when(k == 2, "INVALIDATE").when(k == 3, "UPDATE").otherwise("WHAT").alias("action"))
    return layers.dispatched(kos, decisions, existing, "x")[1]


@query(
    f"""WITH {BUNDLES}, {IDS}, r AS (SELECT DISTINCT * FROM (SELECT 'L0' AS layer, p0 AS pid FROM ids WHERE s <> '' UNION ALL SELECT 'L1', p1 FROM ids WHERE s <> '' UNION ALL SELECT 'L2', p2 FROM ids UNION ALL SELECT 'L3', p3 FROM ids)), g AS (SELECT pid FROM r WHERE layer <> 'L1' AND substr(pid, length(pid)) IN ('2', '7'))
  SELECT layer, CASE WHEN pid IN (SELECT pid FROM g) THEN 'deleted' END AS status, count(*) AS n FROM r WHERE NOT (layer = 'L0' AND pid IN (SELECT pid FROM g)) GROUP BY ALL
  UNION ALL SELECT 'link ' || rel, CASE WHEN dead THEN 'deleted' END, count(*) FROM (SELECT DISTINCT rel, a, b, dead FROM (SELECT 'L0_GENERATED' AS rel, p0 AS a, p1 AS b, p0 IN (SELECT pid FROM g) AS dead FROM ids WHERE s <> '' UNION ALL SELECT 'GENERATED', p0, role, p0 IN (SELECT pid FROM g) FROM ids WHERE s <> ''
    UNION ALL SELECT 'INVOLVES', sid, role, p2 IN (SELECT pid FROM g) FROM ids UNION ALL SELECT 'BELONGS_TO', p1, sid, false FROM ids WHERE s <> '' UNION ALL SELECT 'DESCRIBES', p1, p3, false FROM ids WHERE s <> '')) WHERE NOT (rel = 'L0_GENERATED' AND dead) GROUP BY ALL"""
)
def soft_delete_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Upper-layer records deleted softly, with their links."""
    w, none = _written(spark, sf), F.lit(None).cast("string")
    records = w.records.select("layer", "pid", "scenario_id").distinct().withColumn("status", none)
    gone = records.filter((F.col("layer") != "L1") & F.substring("pid", -1, 1).isin("2", "7"))
    r, links = layers.soft_deleted(records, w.links.withColumn("status", none), gone)
    return r.groupBy("layer", "status").agg(F.count("*").alias("n")).unionByName(links.groupBy(F.concat(F.lit("link "), "rel").alias("layer"), "status").agg(F.count("*").alias("n")))


#: Results that an earlier recall left: for each benchmark item the documents of its number and the next.
RESULTS = "results AS (SELECT item_id AS query_id, CAST(doc_id AS VARCHAR) AS pid, text AS summary, doc_id - item_id AS rank FROM (SELECT item_id FROM benchmark) JOIN documents ON doc_id IN (item_id, item_id + 1))"


def _results(spark: SparkSession, sf: str) -> DataFrame:
    b, m = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")), A.memories(spark, sf).select("pid", "summary")
    return b.withColumn("rank", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("pid", (F.col("query_id") + F.col("rank")).cast("string")).join(m, "pid")


@query(
    f"""WITH {Q.MEMORIES}, {RESULTS}, t AS (SELECT query_id, substr(arg_min(summary, rank), 1, 120) AS summary FROM results GROUP BY query_id)
  SELECT 'memory' AS kind, pid AS id, NULL AS status FROM memories WHERE summary NOT IN (SELECT summary FROM t)
  UNION ALL SELECT 'edge', lang || '-' || source, CASE WHEN lang || '-' || source IN (SELECT arg_min(d.lang || '-' || d.source, rank) FROM results r JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.pid GROUP BY query_id) THEN 'deleted' END FROM (SELECT DISTINCT lang, source FROM documents)"""
)
def delete_by_query(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's best result deleted; edges that carry a deleted summary too."""
    m, d, r = A.memories(spark, sf), A.table(spark, sf, "documents"), _results(spark, sf)
    pair = F.concat_ws("-", "lang", "source")
    told = layers.target_of(r).join(d.select(F.col("doc_id").cast("string").alias("pid"), pair.alias("eid")), "pid").groupBy("eid").agg(F.min("summary").alias("ko_summary"))
    edges = d.select(pair.alias("eid")).distinct().join(told, "eid", "left").withColumn("status", F.lit(None).cast("string"))
    kept, marked = layers.delete_by_query(r, m, edges)
    return kept.select(F.lit("memory").alias("kind"), F.col("pid").alias("id"), F.lit(None).cast("string").alias("status")).unionByName(marked.select(F.lit("edge").alias("kind"), F.col("eid").alias("id"), "status"))


@query(
    f"""WITH {Q.MEMORIES}, {RESULTS}, t AS (SELECT query_id, substr(arg_min(summary, rank), 1, 120) AS summary FROM results GROUP BY query_id),
  near AS (SELECT t.query_id, m.pid, m.collection, {Q.cosine("v.embedding", "m.embedding")} AS sim FROM t JOIN embeddings v ON v.vec_id = length(t.summary) % 100, memories m WHERE m.embedding IS NOT NULL),
  found_at AS (SELECT query_id, pid FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, pid) AS n FROM near WHERE sim >= 0.61) WHERE n = 1),
  new AS (SELECT pid, min('updated by ' || query_id) AS summary FROM found_at GROUP BY pid)
  SELECT m.pid, md5(CASE WHEN n.pid IS NULL THEN m.summary WHEN m.summary <> '' THEN m.summary || ' | ' || n.summary ELSE n.summary END) AS digest, CASE WHEN n.pid IS NULL THEN 'keep' ELSE 'update' END AS action FROM memories m LEFT JOIN new n ON n.pid = m.pid"""
)
def update_by_query(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's best result found again by its text's vector and merged with a new record."""
    m, none = A.memories(spark, sf).withColumn("evidence", F.lit("").cast("string")), F.array().cast("array<string>")
    new = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("updated by "), F.col("item_id").cast("string")).alias("summary"), none.alias("entities"), none.alias("tags"), F.lit("e").alias("evidence"))
    out = layers.update_by_query(_results(spark, sf), new, m, number_model(spark, sf))
    return out.select("pid", F.md5(F.col("summary").cast("binary")).alias("digest"), "action")


@query("SELECT conv_id, turn, role, md5(CASE WHEN strlen(log) > 600 THEN (CASE WHEN position(chr(10) || '### ' IN rest) > 0 THEN substr(rest, position(chr(10) || '### ' IN rest) + 1) ELSE rest END) ELSE log END) AS digest FROM (SELECT *, substr(log, length(log) // 2 + 1) AS rest FROM (SELECT conv_id, turn, role, '### a' || chr(10) || text || chr(10) || '### b' || chr(10) || text || chr(10) || '### c' || chr(10) || text AS log FROM conversations))")
def log_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Logs above a byte limit lose their first half, up to the next block."""
    log = F.concat(F.lit("### a\n"), "text", F.lit("\n### b\n"), "text", F.lit("\n### c\n"), "text")
    return A.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.md5(layers.rolled(log, 600).cast("binary")).alias("digest"))


