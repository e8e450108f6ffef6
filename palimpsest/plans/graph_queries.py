"""Queries over the graph and its audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import schemas as S
from palimpsest.functions import text as T
from palimpsest.operators import audit, graph, writes
from palimpsest.plans import sql as Q
from palimpsest.plans.catalog import query
from palimpsest.plans.search_queries import STEPS
from palimpsest.sources import adapters as A

SEEDS = "seeds AS (SELECT n_nationkey AS query_id, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region)"
CLEAN = f"CASE WHEN upper(pred) NOT IN ({Q.values(S.PREDICATES)}) THEN 'MENTIONED_IN' ELSE upper(pred) END"


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    n, r = A.table(spark, sf, "nation"), A.table(spark, sf, "region")
    return n.select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("name")).unionByName(r.select((F.col("r_regionkey") + 100).alias("query_id"), F.col("r_name").alias("name")))


@query(
    f"""WITH {Q.EDGES}, {SEEDS}, {STEPS} SELECT query_id, src, dst, pred, summary, n FROM (SELECT query_id, s.*, row_number() OVER (PARTITION BY query_id, src ORDER BY updated DESC NULLS LAST, dst, pred, s.summary) AS n
  FROM seeds JOIN steps s ON s.src = seeds.name) WHERE n <= 4"""
)
def graph_expand_1hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.expand_one(_seeds(spark, sf), A.edges(spark, sf)).select("query_id", "src", "dst", "pred", "summary", "n")


GEO = f"geo AS (SELECT DISTINCT src, dst FROM (SELECT subj AS src, obj AS dst FROM edges WHERE {Q.ACTIVE} UNION ALL SELECT obj, subj FROM edges WHERE {Q.ACTIVE}) WHERE src <> dst)"


@query(
    f"""WITH {Q.EDGES}, {GEO}, s AS (SELECT r_regionkey AS query_id, r_name AS name FROM region), h1 AS (SELECT DISTINCT query_id, dst AS name, [s.name, dst] AS path FROM s JOIN geo ON src = s.name),
  h2 AS (SELECT query_id, g.dst AS name, min(list_append(path, g.dst)) AS path FROM h1 JOIN geo g ON g.src = h1.name WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = h1.query_id AND s.name = g.dst) AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.query_id = h1.query_id AND x.name = g.dst) GROUP BY ALL)
  SELECT query_id, name, 0 AS hop, name AS path FROM s UNION ALL SELECT query_id, name, 1, array_to_string(path, '>') FROM h1 UNION ALL SELECT query_id, name, 2, array_to_string(path, '>') FROM h2"""
)
def graph_expand_khop(spark: SparkSession, sf: str) -> DataFrame:
    seeds = A.table(spark, sf, "region").select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("name"))
    out = graph.expand_paths(seeds, A.edges(spark, sf))
    return out.select("query_id", "name", "hop", F.array_join("path", ">").alias("path"))


@query(
    """WITH asked AS (SELECT DISTINCT lower(n_name) AS name FROM nation UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part), known AS (SELECT DISTINCT n_name AS alias FROM nation UNION SELECT DISTINCT p_name FROM part),
  s AS (SELECT name, alias, CASE WHEN lower(name) = lower(alias) THEN 1.0::DOUBLE WHEN contains(lower(name), lower(alias)) OR contains(lower(alias), lower(name)) THEN 0.7::DOUBLE ELSE 0 END AS score FROM asked, known WHERE length(name) >= 2)
  SELECT name, alias, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, alias) AS n FROM s WHERE score >= 0.7) WHERE n = 1 AND name <> alias"""
)
def alias_resolve(spark: SparkSession, sf: str) -> DataFrame:
    n, p = A.table(spark, sf, "nation"), A.table(spark, sf, "part")
    names = n.select(F.lower("n_name").alias("name")).union(p.select(F.substring_index("p_name", " ", 1)))
    return graph.resolve_alias(names, n.select(F.col("n_name").alias("name")).union(p.select("p_name")))


@query(
    f"""WITH {Q.MEMORIES}, paths AS (SELECT 1 AS query_id, 'en' AS name, 1 AS hop UNION ALL SELECT 1, 'src2', 2 UNION ALL SELECT 2, 'src3', 1), asked AS (SELECT 1 AS query_id, ['en', 'src5'] AS names UNION ALL SELECT 2, ['zz']),
  i AS (SELECT pid, importance, ts, entities, unnest(entities) AS name FROM memories), h AS (SELECT query_id, pid, min(hop) AS hop, any_value(importance) AS importance, any_value(ts) AS ts, any_value(entities) AS entities FROM i JOIN paths USING (name) GROUP BY query_id, pid),
  o AS (SELECT h.*, len(list_intersect(names, entities)) / CAST(len(names) AS DOUBLE) AS overlap FROM h JOIN asked USING (query_id)),
  s AS (SELECT *, round(0.4 * overlap + 0.25 * power(0.5, hop - 1) + 0.2 * greatest(0, least(1, importance)) + 0.15 * CASE WHEN ts IS NULL THEN 1.0 ELSE greatest(0.5, 1 - {Q.days("ts")} / 540.0) END, 4) AS assoc_score FROM o WHERE NOT (overlap < 0.1 AND hop > 1))
  SELECT query_id, pid, hop, overlap, assoc_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY assoc_score DESC, pid) AS n FROM s) WHERE n <= 20"""
)
def association_expand(spark: SparkSession, sf: str) -> DataFrame:
    paths = spark.createDataFrame([(1, "en", 1), (1, "src2", 2), (2, "src3", 1)], "query_id int, name string, hop int")
    asked = spark.createDataFrame([(1, ["en", "src5"]), (2, ["zz"])], "query_id int, names array<string>")
    return graph.associate(asked, paths, A.memories(spark, sf))


@query(f"WITH {Q.EDGES} SELECT subj, pred, obj, count(*) AS cnt FROM edges WHERE {Q.ACTIVE} GROUP BY ALL HAVING count(*) > 1")
def edge_dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    return audit.duplicate_edges(A.edges(spark, sf))


@query(f"WITH {Q.EDGES} SELECT eid FROM (SELECT eid, row_number() OVER (PARTITION BY subj, pred, obj ORDER BY updated DESC NULLS LAST, eid) AS n FROM edges) WHERE n = 1")
def edge_keep_latest(spark: SparkSession, sf: str) -> DataFrame:
    return writes.keep_latest_edges(A.edges(spark, sf)).select("eid")


@query(
    f"""WITH {Q.EDGES}, w AS (SELECT *, {Q.ACTIVE} AS act, row_number() OVER (PARTITION BY subj, pred, obj, {Q.ACTIVE} ORDER BY coalesce(ko_summary <> '', false) DESC, updated DESC NULLS LAST, eid) AS n,
  first_value(ko_summary) OVER (PARTITION BY subj, pred, obj, {Q.ACTIVE} ORDER BY coalesce(ko_summary <> '', false) DESC, updated DESC NULLS LAST, eid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep FROM edges)
  SELECT eid, CASE WHEN act AND n > 1 THEN 'superseded' ELSE status END AS status, CASE WHEN act AND n > 1 THEN substr(coalesce(keep, ''), 1, 200) ELSE superseded_by END AS superseded_by FROM w"""
)
def edge_supersede(spark: SparkSession, sf: str) -> DataFrame:
    return writes.supersede_duplicates(A.edges(spark, sf)).select("eid", "status", "superseded_by")


@query(
    f"""WITH {Q.EDGES}, {Q.NODES} SELECT 'predicate' AS kind, pred AS name, count(*) AS n FROM edges WHERE {CLEAN} <> pred GROUP BY pred
  UNION ALL SELECT 'label', coalesce(label, '<NULL>'), count(*) FROM nodes WHERE label IS NULL OR label NOT IN ({Q.values(S.LABELS)}) GROUP BY label"""
)
def schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.schema_violations(A.nodes(spark, sf), A.edges(spark, sf))


@query(f"WITH {Q.EDGES}, r AS (SELECT subj, {CLEAN} AS pred, obj, eid, updated FROM edges) SELECT pred, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY subj, pred, obj ORDER BY updated DESC NULLS LAST, eid) AS k FROM r) WHERE k = 1 GROUP BY pred")
def schema_repair(spark: SparkSession, sf: str) -> DataFrame:
    return graph.repaired(A.nodes(spark, sf), A.edges(spark, sf))[1].groupBy("pred").agg(F.count("*").alias("n"))


@query(f"WITH {Q.MEMORIES} SELECT md5(summary) AS digest, count(DISTINCT collection) AS n, string_agg(DISTINCT collection, ',' ORDER BY collection) AS collections FROM memories WHERE summary <> '' GROUP BY 1 HAVING count(DISTINCT collection) > 1")
def cross_collection_dup(spark: SparkSession, sf: str) -> DataFrame:
    return audit.cross_collection(A.memories(spark, sf))


@query(f"WITH {Q.EDGES}, r AS (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation WHERE n_regionkey < 2) SELECT eid FROM edges WHERE {Q.ACTIVE} AND (ko_summary IS NULL OR ko_summary <> 'geography') AND NOT coalesce(source <> '' AND contains('geography', source), false) AND NOT (subj IN (SELECT name FROM r) AND obj IN (SELECT name FROM r))")
def orphan_edges(spark: SparkSession, sf: str) -> DataFrame:
    n, r = A.table(spark, sf, "nation"), A.table(spark, sf, "region")
    names = r.select(F.col("r_name").alias("x")).union(n.filter("n_regionkey < 2").select("n_name"))
    m = names.select(F.lit("geography").alias("summary"), F.array("x").alias("entities"))
    return audit.orphan_edges(A.edges(spark, sf), m).select("eid")


@query(f"WITH {Q.NODES}, g AS (SELECT DISTINCT name FROM nodes), v AS (SELECT DISTINCT upper(n_name) AS name FROM nation UNION SELECT lang FROM documents) SELECT 'graph' AS side, name FROM g WHERE name NOT IN (SELECT name FROM v) UNION ALL SELECT 'vector', name FROM v WHERE name NOT IN (SELECT name FROM g)")
def entity_diff(spark: SparkSession, sf: str) -> DataFrame:
    names = A.table(spark, sf, "nation").select(F.upper("n_name").alias("n")).union(A.table(spark, sf, "documents").select("lang"))
    return audit.entity_difference(A.nodes(spark, sf), names.select(F.array("n").alias("entities")))


@query(f"WITH {Q.EDGES} SELECT pred, count(*) AS n, pred IN ({Q.values(S.PREDICATES)}) AS allowed, {CLEAN} AS should_be FROM edges GROUP BY pred")
def predicate_hist(spark: SparkSession, sf: str) -> DataFrame:
    return audit.predicate_histogram(A.edges(spark, sf))


@query(f"WITH {Q.NODES} SELECT labels, count(*) AS n FROM (SELECT name, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM nodes GROUP BY name) GROUP BY labels")
def label_hist(spark: SparkSession, sf: str) -> DataFrame:
    return audit.label_histogram(A.nodes(spark, sf))


@query(f"WITH {Q.EDGES} SELECT coalesce(source, '<NULL>') AS source, coalesce(ko_summary, '<NULL>') AS ko_summary, count(*) AS n FROM edges GROUP BY 1, 2 ORDER BY n DESC, source, ko_summary LIMIT 20")
def source_dist(spark: SparkSession, sf: str) -> DataFrame:
    return audit.source_distribution(A.edges(spark, sf))


@query(f"WITH {Q.EDGES} SELECT eid FROM edges WHERE status = 'superseded' AND coalesce(superseded_by, '') = ''")
def dead_superseded(spark: SparkSession, sf: str) -> DataFrame:
    return audit.dead_superseded(A.edges(spark, sf)).select("eid")


@query(
    f"""WITH {Q.NODES}, {Q.EDGES}, c AS (SELECT (SELECT count(DISTINCT name) FROM nodes) AS entities, (SELECT count(*) FROM edges) AS relations, (SELECT count(*) FROM documents) AS points)
  SELECT *, round(relations / points, 4) AS ratio, CASE WHEN round(relations / points, 4) > 1.5 THEN 'high' WHEN round(relations / points, 4) < 0.7 THEN 'low' ELSE 'ok' END AS band FROM c"""
)
def count_recon(spark: SparkSession, sf: str) -> DataFrame:
    return audit.reconcile(A.nodes(spark, sf), A.edges(spark, sf), A.memories(spark, sf))


@query(f"WITH {Q.MEMORIES} SELECT collection, count(*) AS n FROM memories GROUP BY collection")
def collection_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.memories(spark, sf).groupBy("collection").agg(F.count("*").alias("n"))


@query(f"WITH {Q.EDGES} SELECT count(ko_summary) AS n_ko_summary FROM edges")
def drop_long_text(spark: SparkSession, sf: str) -> DataFrame:
    return writes.drop_long_text(A.edges(spark, sf))[1]


@query(f"WITH {Q.EDGES}, {Q.NODES} SELECT count(*) AS n, count(DISTINCT subj) AS subjects FROM edges e WHERE EXISTS (SELECT 1 FROM nodes WHERE name = e.subj) AND EXISTS (SELECT 1 FROM edges x WHERE x.subj = e.obj AND coalesce(x.status, 'active') <> 'deleted')")
def edge_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with a known subject whose object has an edge of its own that is not deleted (semi-joins)."""
    e = A.edges(spark, sf)
    live = e.filter("coalesce(status, 'active') <> 'deleted'").select(F.col("subj").alias("obj")).distinct()
    out = e.join(A.nodes(spark, sf).select(F.col("name").alias("subj")), "subj", "left_semi").join(live, "obj", "left_semi")
    return out.agg(F.count("*").alias("n"), F.count_distinct("subj").alias("subjects"))


@query(
    f"""WITH {Q.EDGES}, s AS (SELECT eid, coalesce(nullif(ko_summary, ''), subj || ' ' || pred || ' ' || obj) AS summary FROM edges) SELECT eid, length(summary) >= 6 AND len(regexp_split_to_array({Q.strip("summary")}, '\\s+')) > 3
  AND NOT list_bool_or(list_transform(regexp_split_to_array({Q.strip("summary")}, '\\s+'), lambda w: length(w) > 3 AND w = upper(w) AND w <> lower(w))) AS keeps FROM s"""
)
def graph_filler(spark: SparkSession, sf: str) -> DataFrame:
    return A.edges(spark, sf).select("eid", T.graph_filler(graph.edge_summary()).alias("keeps"))
