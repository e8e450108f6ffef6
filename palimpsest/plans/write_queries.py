"""Queries over ingest and mutations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import writes
from palimpsest.plans import sql as Q
from palimpsest.plans.catalog import query
from palimpsest.sources import adapters as A
from palimpsest.sources import files

VERSIONS = "v AS (SELECT CAST(user_id AS VARCHAR) AS pid, event_type AS collection, CAST(value AS DOUBLE) AS value, ts AS recorded_at, event_id FROM events)"


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("pid"), F.col("event_type").alias("collection"), "value", F.col("ts").cast("timestamp").alias("recorded_at"), "event_id")


@query(f"WITH {VERSIONS} SELECT collection, pid, event_id FROM (SELECT *, row_number() OVER (PARTITION BY collection, pid ORDER BY recorded_at DESC, event_id % 2 DESC, event_id DESC) AS n FROM v) WHERE n = 1")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    v = _versions(spark, sf)
    return writes.upsert(v.filter("event_id % 2 = 0"), v.filter("event_id % 2 = 1"), tie="event_id").select("collection", "pid", "event_id")


@query(f"WITH {VERSIONS}, h AS (SELECT pid, min(collection) AS held FROM v GROUP BY pid) SELECT CAST(c_custkey AS VARCHAR) AS pid, coalesce(held, c_mktsegment) AS collection FROM customer LEFT JOIN h ON h.pid = CAST(c_custkey AS VARCHAR)")
def existing_collection(spark: SparkSession, sf: str) -> DataFrame:
    new = A.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("pid"), F.col("c_mktsegment").alias("collection"))
    return writes.place(new, _versions(spark, sf)).select("pid", "collection")


@query(
    """WITH o AS (SELECT CAST(doc_id AS VARCHAR) AS pid, text AS summary, [lang, source] AS entities, [lang] AS tags, source AS evidence FROM documents WHERE doc_id % 3 < 2),
  n AS (SELECT CAST(doc_id AS VARCHAR) AS pid, CASE WHEN doc_id % 2 = 0 THEN text ELSE lang END AS summary, [source, 'new'] AS entities, ['t', lang] AS tags, 'e' AS evidence FROM documents WHERE doc_id % 3 > 0)
  SELECT coalesce(o.pid, n.pid) AS pid, md5(CASE WHEN o.summary <> '' AND n.summary <> '' AND o.summary <> n.summary THEN o.summary || ' | ' || n.summary ELSE coalesce(nullif(n.summary, ''), nullif(o.summary, ''), '') END) AS digest,
  array_to_string(CASE WHEN o.pid IS NULL THEN n.entities WHEN n.pid IS NULL THEN o.entities ELSE list_append(o.entities, 'new') END, '|') AS entities,
  array_to_string(CASE WHEN o.pid IS NULL THEN n.tags WHEN n.pid IS NULL THEN o.tags ELSE list_append(o.tags, 't') END, '|') AS tags, concat_ws(' | ', o.evidence, n.evidence) AS evidence,
  CASE WHEN o.pid IS NOT NULL AND n.pid IS NOT NULL THEN substr(o.summary, 1, 100) END AS merged_from, CASE WHEN o.pid IS NULL THEN 'create' WHEN n.pid IS NULL THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n ON o.pid = n.pid"""
)
def merge_update(spark: SparkSession, sf: str) -> DataFrame:
    d, pid = A.table(spark, sf, "documents"), F.col("doc_id").cast("string").alias("pid")
    old = d.filter("doc_id % 3 < 2").select(pid, F.col("text").alias("summary"), F.array("lang", "source").alias("entities"), F.array("lang").alias("tags"), F.col("source").alias("evidence"))
    new = d.filter("doc_id % 3 > 0").select(pid, F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("lang")).alias("summary"), F.array(F.col("source"), F.lit("new")).alias("entities"), F.array(F.lit("t"), F.col("lang")).alias("tags"), F.lit("e").alias("evidence"))
    out = writes.merge_update(old, new)
    return out.select("pid", F.md5(F.col("summary").cast("binary")).alias("digest"), F.array_join("entities", "|").alias("entities"), F.array_join("tags", "|").alias("tags"), "evidence", "merged_from", "action")


@query(
    f"""WITH {Q.EDGES}, o AS (SELECT DISTINCT n_name AS subj, r_name AS obj FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2), p AS (SELECT DISTINCT subj, obj FROM edges WHERE pred = 'ORDERED' AND source = '1-URGENT')
  SELECT eid, CASE WHEN hit AND {Q.ACTIVE} THEN 'superseded' ELSE status END AS status, CASE WHEN hit AND {Q.ACTIVE} THEN 'moved' ELSE superseded_by END AS superseded_by FROM (SELECT e.*, (pred = 'PART_OF' AND o.subj IS NOT NULL) OR (pred = 'ORDERED' AND p.subj IS NOT NULL) AS hit FROM edges e LEFT JOIN o ON o.subj = e.subj AND o.obj = e.obj LEFT JOIN p ON p.subj = e.subj AND p.obj = e.obj)"""
)
def override_scd2(spark: SparkSession, sf: str) -> DataFrame:
    e = A.edges(spark, sf)
    n, r = A.table(spark, sf, "nation"), A.table(spark, sf, "region").filter("r_regionkey < 2")
    o = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("subj"), F.lit("PART_OF").alias("pred"), F.col("r_name").alias("obj"))
    o = o.union(e.filter("pred = 'ORDERED' and source = '1-URGENT'").select("subj", "pred", "obj").distinct()).withColumn("summary", F.lit("moved"))
    return writes.supersede(e, o, datetime(2024, 1, 31)).select("eid", "status", "superseded_by")


@query(
    """WITH l1 AS (SELECT 'd' || doc_id AS pid FROM documents), up AS (SELECT 'c' || conv_id || '-' || turn || '-' || role AS pid, ['d' || conv_id, 'd' || (conv_id * 2)] AS l FROM conversations), gone AS (SELECT 'd' || doc_id AS pid FROM documents WHERE source = 'src3')
  SELECT pid, 'L1' AS layer FROM l1 WHERE pid NOT IN (SELECT pid FROM gone) UNION ALL SELECT pid, 'L2' FROM up WHERE len(list_intersect(l, (SELECT list(pid) FROM gone))) = 0"""
)
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    return writes.cascade_delete(_layers(spark, sf), _gone(spark, sf)).select("pid", "layer")


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    d, c = A.table(spark, sf, "documents"), A.table(spark, sf, "conversations")
    l1 = d.select(F.concat(F.lit("d"), "doc_id").alias("pid"), F.lit("L1").alias("layer"), F.array().cast("array<string>").alias("linked_l1_pids"))
    up = c.select(F.concat(F.lit("c"), F.concat_ws("-", "conv_id", "turn", "role")).alias("pid"), F.lit("L2").alias("layer"), F.array(F.concat(F.lit("d"), "conv_id"), F.concat(F.lit("d"), F.col("conv_id") * 2)).alias("linked_l1_pids"))
    return l1.unionByName(up)


def _gone(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").filter("source = 'src3'").select(F.concat(F.lit("d"), "doc_id").alias("pid"))


@query("SELECT 'L2' AS src_layer, 'c' || conv_id || '-' || turn || '-' || role AS src_id, 'INVOLVES' AS rel, 'L1' AS dst_layer, unnest(['d' || conv_id, 'd' || (conv_id * 2)]) AS dst_id FROM conversations")
def provenance_links(spark: SparkSession, sf: str) -> DataFrame:
    return writes.links_of(_layers(spark, sf).filter("layer = 'L2'"))


@query(f"WITH {Q.MEMORIES}, g AS (SELECT text AS summary FROM documents WHERE source = 'src3') SELECT pid FROM memories WHERE summary NOT IN (SELECT summary FROM g)")
def delete_by_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = A.memories(spark, sf)
    return writes.delete_by_summary(m, A.edges(spark, sf), m.filter("collection = 'src3'").select("summary"))[0].select("pid")


@query(f"WITH {Q.EDGES} SELECT eid, CASE WHEN ko_summary = 'geography' THEN 'deleted' ELSE status END AS status FROM edges")
def soft_delete(spark: SparkSession, sf: str) -> DataFrame:
    e = A.edges(spark, sf)
    m = spark.createDataFrame([("1", "geography"), ("2", "other")], "pid string, summary string")
    return writes.delete_by_pids(m, e, m.filter("pid = '1'"))[1].select("eid", "status")


@query(
    """WITH b AS (SELECT text AS k, 0 AS is_new, conv_id * 1000 + turn AS pos, role FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT text, 1, conv_id * 1000 + turn, role FROM conversations WHERE conv_id % 2 = 1)
  SELECT md5(k) AS digest, is_new, pos FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY is_new, pos) AS n FROM b) WHERE n = 1"""
)
def runtime_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "conversations").select(F.col("text").alias("k"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "conv_id")
    out = writes.runtime_merge(c.filter("conv_id % 2 = 0").drop("conv_id"), c.filter("conv_id % 2 = 1").drop("conv_id"), ["k"])
    return out.select(F.md5(F.col("k").cast("binary")).alias("digest"), "is_new", "pos")


@query("SELECT doc_id, 1 + doc_id % 2 AS n_kos, md5(text) AS digest, lang AS first_type FROM documents")
def four_layer_source(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as four-layer JSON of several shapes and read back through the source."""
    ko = F.struct(F.col("lang").alias("type"), F.col("text").alias("summary"))
    two = F.to_json(F.array(ko, ko))
    one = F.to_json(ko)
    value = F.when(F.col("doc_id") % 2 == 1, F.when(F.col("doc_id") % 3 == 0, two).otherwise(F.concat(F.lit('{"l1":{"kos":'), two, F.lit("}}")))).otherwise(F.concat(F.lit('{"l0":null,"l1":'), one, F.lit("}")))
    out = files.four_layers(A.table(spark, sf, "documents").select("doc_id", value.alias("value")))
    return out.select("doc_id", F.size("kos").alias("n_kos"), F.md5(F.try_element_at("kos", F.lit(1))["summary"].cast("binary")).alias("digest"), F.try_element_at("kos", F.lit(1))["type"].alias("first_type"))


@query("SELECT doc_id, 1 AS n, md5(substr(text, 1, 200)) AS digest FROM documents")
def reply_salvage(spark: SparkSession, sf: str) -> DataFrame:
    ko = F.to_json(F.struct(F.lit("fact").alias("type"), F.translate("text", "{}[]", "    ").alias("summary")))
    reply = F.concat(F.lit("<think>maybe [1]</think>\n```json\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("["), ko, F.lit("]"))).otherwise(F.concat(F.lit("first: "), ko)), F.lit("\n```"))
    out = A.table(spark, sf, "documents").select("doc_id", "text", files.salvage_kos(reply).alias("k"))
    return out.select("doc_id", F.size("k").alias("n"), F.md5(F.col("k")[0]["summary"].cast("binary")).alias("digest"))


@query("SELECT event_id, event_type AS event, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at, json_extract_string(props, '$.k') AS k FROM events")
def event_log_source(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as Markdown blocks with a fenced JSON field, and parsed."""
    e = A.table(spark, sf, "events")
    block = F.concat(F.lit("### "), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), F.col("event_type"), F.lit("\n- **id**: "), F.col("event_id").cast("string"), F.lit("\n- **props**:\n```json\n"), F.col("props"), F.lit("\n```\n"))
    out = files.event_log(e.select(block.alias("value")))
    return out.select(F.col("fields")["id"].cast("long").alias("event_id"), "event", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.get_json_object(F.col("fields")["props"], "$.k").alias("k"))


@query("SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'SKIP' WHEN 1 THEN 'CREATE' WHEN 2 THEN 'INVALIDATE' END AS action FROM conversations")
def reply_decisions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("conv_id") % 4
    reply = F.when(k == 0, '{"action": "skip", "reason": "same"}').when(k == 1, 'So:\n```json\n{"action": "CREATE"}\n```').when(k == 2, 'I say {"action":"INVALIDATE","reason":"old"} now').otherwise("none")
    return A.table(spark, sf, "conversations").select("conv_id", "turn", T.decision_action(reply).alias("action"))


@query(
    f"""WITH k AS (SELECT doc_id, ('0x' || substr(md5('qdrant-v6|' || array_to_string(list_sort([lang, source]), '::') || '||' || lang || '|KNOWS|' || source), 1, 16))::UBIGINT::VARCHAR AS pid, lang, source FROM documents WHERE {Q.strip("text")} <> '')
  SELECT lang AS subj, 'KNOWS' AS pred, source AS obj, count(*) AS records FROM k GROUP BY ALL"""
)
def ingest_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Records cleaned and built, their graph taken: one edge for each triple, joined back to the records that state it."""
    e = lambda c: F.struct(c.alias("name"), F.lit("Concept").alias("label"))
    none = F.struct(*[F.lit(None).cast("string").alias(n) for n in ("start", "end", "expression", "precision")])
    valid = F.struct(*[F.lit(None).cast("string").alias(n) for n in ("start", "end", "end_type")])
    rel = F.array(F.struct(F.col("lang").alias("subject"), F.lit("knows").alias("predicate"), F.col("source").alias("object"), F.lit(None).cast("string").alias("status")))
    kos = A.table(spark, sf, "documents").select(F.lit("fact").alias("type"), F.col("text").alias("summary"), F.array(e(F.col("lang")), e(F.col("source"))).alias("entities"), rel.alias("relations"), F.lit(0.5).alias("importance"), none.alias("event_time"), valid.alias("valid_time"))
    l1 = writes.build_l1(writes.clean_kos(kos), "2024-01-31T00:00:00+08:00")
    edges = writes.graph_of(l1)[1].select("subj", "pred", "obj")
    stated = l1.select(F.explode("relations").alias("r")).groupBy(F.col("r.subject").alias("subj"), F.col("r.object").alias("obj")).agg(F.count("*").alias("records"))
    return edges.join(stated, ["subj", "obj"]).select("subj", "pred", "obj", "records")


@query("SELECT item_id AS query_id, 'delete' AS action, strftime(TIMESTAMP '2024-01-31 00:05:00', '%Y-%m-%d %H:%M:%S') AS expires, 1 AS n FROM benchmark")
def action_tokens(spark: SparkSession, sf: str) -> DataFrame:
    b = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(1).alias("rank"), F.col("item_id").cast("string").alias("pid"), F.lit("L1").alias("layer"), F.col("text").alias("summary"))
    out = writes.issue_tokens(b, "delete", datetime(2024, 1, 31))
    return out.select("query_id", "action", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires"), F.size("candidates").alias("n"))
