"""Property-graph operators over nodes(name, label) and edges(subj, pred, obj, status, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest import schemas as S
from palimpsest.functions import scoring as X
from palimpsest.functions.text import Segmenter, grams, sanitize_label, sanitize_predicate
from palimpsest.operators import bm25
from palimpsest.params import DEFAULT, Params


def active() -> Column:
    """A missing status counts as active."""
    return F.coalesce("status", F.lit("active")) == "active"


def edge_summary() -> Column:
    return F.coalesce(F.when(F.col("ko_summary") != "", F.col("ko_summary")), F.concat_ws(" ", "subj", "pred", "obj"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected steps: src, dst, pred, summary, updated."""
    e = edges.withColumn("summary", edge_summary())
    cols = ["pred", "summary", "updated"]
    return e.select(F.col("subj").alias("src"), F.col("obj").alias("dst"), *cols).unionByName(e.select(F.col("obj").alias("src"), F.col("subj").alias("dst"), *cols))


def expand_one(seeds: DataFrame, edges: DataFrame, limit: int | None = None, p: Params = DEFAULT) -> DataFrame:
    """query_id, src, dst, pred, summary, n: the newest neighbours of each seed (query_id, name), distinct, at most `limit` for each."""
    limit = p.neighbour_limit if limit is None else limit
    steps = both_ways(edges.filter(active())).filter("dst is not null").groupBy("src", "dst", "pred", "summary").agg(F.max("updated").alias("updated"))
    hit = seeds.select("query_id", F.col("name").alias("src")).distinct().join(steps, "src")
    order = W.partitionBy("query_id", "src").orderBy(F.desc_nulls_last("updated"), "dst", "pred", "summary")
    return hit.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)


def expand_paths(seeds: DataFrame, edges: DataFrame, hops: int | None = None, limit: int | None = None, p: Params = DEFAULT) -> DataFrame:
    """query_id, name, hop, path: breadth-first; the fewest hops win, then the smallest path. limit: neighbours followed from each node.

    Each hop is one join on the steps of distinct node pairs and one anti-join with the visited names.
    """
    hops = p.assoc_hops if hops is None else hops
    steps = both_ways(edges.filter(active())).filter("dst is not null and src <> dst").select("src", "dst").distinct()
    if limit:
        steps = steps.withColumn("n", F.row_number().over(W.partitionBy("src").orderBy("dst"))).filter(F.col("n") <= limit).drop("n")
    seen = seeds.select("query_id", "name").distinct().select("query_id", "name", F.lit(0).alias("hop"), F.array("name").alias("path"))
    edge = seen
    for hop in range(1, hops + 1):
        moved = edge.join(steps, edge.name == steps.src).select("query_id", F.col("dst").alias("name"), F.lit(hop).alias("hop"), F.concat("path", F.array("dst")).alias("path"))
        edge = moved.join(seen.select("query_id", "name"), ["query_id", "name"], "left_anti").groupBy("query_id", "name", "hop").agg(F.min("path").alias("path"))
        seen = seen.unionByName(edge)
    return seen


def expand_trails(seeds: DataFrame, edges: DataFrame, hops: int = 2, limit: int | None = None, p: Params = DEFAULT) -> DataFrame:
    """query_id, subj, pred, obj, hop: trails of one to `hops` edges from each seed (query_id, name), in which no edge occurs twice but nodes may.

    pred is that of the first edge. limit: trails for each seed, the shortest first, then by object, predicate and edges. Edges need an eid.
    """
    steps = edges.filter(active()).filter("subj is not null and obj is not null").select("eid", "subj", "pred", "obj")
    steps = steps.select("eid", F.col("subj").alias("src"), "pred", F.col("obj").alias("dst")).unionByName(steps.filter("subj <> obj").select("eid", F.col("obj").alias("src"), "pred", F.col("subj").alias("dst")))
    now = seeds.select("query_id", F.col("name").alias("subj"), F.col("name").alias("at"), F.lit(None).cast("string").alias("pred"), F.array().cast("array<string>").alias("trail")).distinct()
    found = None
    for hop in range(1, hops + 1):
        moved = now.join(steps.withColumnRenamed("pred", "_p"), F.col("at") == F.col("src")).filter(~F.array_contains("trail", F.col("eid")))
        now = moved.select("query_id", "subj", F.col("dst").alias("at"), F.coalesce("pred", "_p").alias("pred"), F.concat("trail", F.array("eid")).alias("trail"))
        rows = now.withColumn("hop", F.lit(hop))
        found = rows if found is None else found.unionByName(rows)
    if limit:
        order = W.partitionBy("query_id", "subj").orderBy("hop", "at", "pred", "trail")
        found = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)
    return found.select("query_id", "subj", "pred", F.col("at").alias("obj"), "hop")


def entity_search(queries: DataFrame, nodes: DataFrame, p: Params = DEFAULT, segment: Segmenter | None = None) -> DataFrame:
    """query_id, name, raw: node names by lexical score, one for each lower-cased name, the best few."""
    index = bm25.build(nodes.select(F.col("name").alias("pid"), F.col("name").alias("summary")).distinct(), stop=[], segment=segment)
    hits = bm25.search(queries, index, k=10 * p.entity_limit, p=p, stop=[], segment=segment)
    one = W.partitionBy("query_id", F.lower("pid")).orderBy(F.desc("raw"), "pid")
    hits = hits.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    order = W.partitionBy("query_id").orderBy(F.desc("raw"), "pid")
    return hits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= p.entity_limit).select("query_id", F.col("pid").alias("name"), "raw", "n")


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner, outer: all pairs of rows (inner) and rows (outer) where the outer string contains the inner one; empty strings meet nothing.

    A string of three characters or more meets on that of its three-character substrings which the fewest outer strings have, a shorter one on
    itself, so that no pair is missed and few are compared in vain.
    """
    held = outer.select("outer").distinct().select("outer", F.explode(F.concat(*(grams(F.col("outer"), n) for n in (1, 2, 3)))).alias("_g"))
    asked = inner.select("inner").distinct().filter("inner <> ''")
    own = asked.select("inner", F.explode(F.when(F.length("inner") >= 3, grams(F.col("inner"), 3)).otherwise(F.array("inner"))).alias("_g"))
    spread = own.join(held.groupBy("_g").agg(F.count("*").alias("n")), "_g", "left")
    rarest = spread.groupBy("inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_g")).alias("k")).filter("k.n > 0")
    return rarest.select("inner", F.col("k._g").alias("_g")).join(held, "_g").filter(F.contains("outer", "inner")).select("inner", "outer")


def resolve_alias(names: DataFrame, nodes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """name, alias, score: the best node that equals the name whatever the case (1.0) or contains it or is contained (0.7), if it differs."""
    asked = names.select("name", F.lower("name").alias("a")).distinct().filter(F.length(F.trim("name")) >= 2)
    known = nodes.select(F.col("name").alias("alias"), F.lower("name").alias("b")).distinct()
    wider = containing(asked.select(F.col("a").alias("inner")), known.select(F.col("b").alias("outer"))).select(F.col("inner").alias("a"), F.col("outer").alias("b"))
    narrower = containing(known.select(F.col("b").alias("inner")), asked.select(F.col("a").alias("outer"))).select(F.col("outer").alias("a"), F.col("inner").alias("b"))
    met = wider.union(narrower).distinct().join(asked, "a").join(known, "b")
    best = W.partitionBy("name").orderBy(F.desc("score"), "alias")
    out = met.withColumn("score", F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.7)).filter(F.col("score") >= p.alias_floor).withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    return out.filter("name <> alias").select("name", "alias", "score")


def associate(queries: DataFrame, paths: DataFrame, memories: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """query_id, pid, hop, overlap, assoc_score: records that name an expanded node, by nearness, overlap, importance and age.

    paths: query_id, name, hop. One row for each query and record (its best), the best `assoc_cap` for each query.
    """
    near = paths.groupBy("query_id", "name").agg(F.min("hop").alias("hop"))
    items = memories.select("pid", "importance", "ts", "entities", F.explode("entities").alias("name"))
    asked = queries.select("query_id", "names")
    hit = items.join(near, "name").filter("hop > 0").groupBy("query_id", "pid").agg(F.min("hop").alias("hop"), F.first("importance").alias("importance"), F.first("ts").alias("ts"), F.first("entities").alias("entities"))
    hit = hit.join(asked, "query_id").withColumn("overlap", X.overlap_ratio(F.col("names"), F.col("entities"))).filter(X.activated(F.col("overlap"), F.col("hop"), p))
    hit = hit.withColumn("assoc_score", X.association_score(F.col("overlap"), F.col("hop"), F.col("importance"), F.col("ts"), p))
    order = W.partitionBy("query_id").orderBy(F.desc("assoc_score"), "pid")
    return hit.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= p.assoc_cap).select("query_id", "pid", "hop", "overlap", "assoc_score")


def spread_names(seeds: DataFrame, edges: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """query_id, name, hop, path, pos: the seeds (query_id, names; hop 1) and what they lead to, in the order of discovery.

    Of each hop's new names the first few go on, each to its newest neighbours; a name counts once whatever its case.
    """
    seen = seeds.select("query_id", F.posexplode("names").alias("pos", "name")).withColumn("name", F.trim("name")).filter(F.length("name") >= 2)
    first = W.partitionBy("query_id", F.lower("name")).orderBy("pos")
    seen = seen.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("query_id", "name", F.lit(1).alias("hop"), F.array("name").alias("path"), F.col("pos").cast("long").alias("pos"))
    edge = seen
    for hop in range(1, p.assoc_hops + 1):
        ahead = edge.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy("pos"))).filter(F.col("_r") <= p.assoc_neighbours)
        near = expand_one(ahead.select("query_id", "name"), edges, p.assoc_neighbours, p).select("query_id", F.col("src").alias("name"), F.col("dst").alias("new"), "n")
        moved = near.join(ahead.select("query_id", "name", "path", "_r"), ["query_id", "name"]).filter(F.length("new") >= 2)
        moved = moved.select("query_id", F.col("new").alias("name"), F.concat("path", F.array("new")).alias("path"), (F.lit(hop * 1_000_000) + F.col("_r") * 1_000 + F.col("n")).cast("long").alias("pos"))
        known = seen.select(F.col("query_id").alias("_q"), F.lower("name").alias("_l"))
        moved = moved.join(known, (F.col("query_id") == F.col("_q")) & (F.lower("name") == F.col("_l")), "left_anti")
        edge = moved.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("query_id", "name", F.lit(hop + 1).alias("hop"), "path", "pos")
        seen = seen.unionByName(edge)
    return seen


def scored_associations(hits: DataFrame, spread: DataFrame, seeds: DataFrame, said: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """query_id, pid, hop, reason, overlap, assoc_score of hits (query_id, pid, summary, importance, ts, entities): the best `assoc_cap` of each query.

    A hit's hop is that of the spread name which it names most (among its entities, in its summary), the first found of equal ones. Hits whose summary is
    a seed's (said: query_id, summary) are left out. A query has few hits and few names, so their join stays small.
    """
    told = said.select(F.col("query_id").alias("_q"), F.lower("summary").alias("_l")).distinct()
    new = hits.join(told, (F.col("query_id") == F.col("_q")) & (F.lower("summary") == F.col("_l")), "left_anti")
    named = F.size(F.filter("entities", lambda e: F.lower(e) == F.lower("name"))) + F.contains(F.lower("summary"), F.lower("name")).cast("int")
    best = new.join(spread.select("query_id", "name", "hop", "path", "pos"), "query_id").withColumn("_c", named)
    best = best.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "pid").orderBy(F.desc("_c"), "pos"))).filter("_n = 1")
    out = best.join(seeds.select("query_id", "names"), "query_id").withColumn("overlap", X.overlap_ratio(F.col("names"), F.col("entities"))).filter(X.activated(F.col("overlap"), F.col("hop"), p))
    out = out.withColumns({"assoc_score": X.association_score(F.col("overlap"), F.col("hop"), F.col("importance"), F.col("ts"), p), "_k": F.substring("summary", 1, 60)})
    out = out.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "_k").orderBy(F.desc("assoc_score"), "pid"))).filter("_n = 1")
    out = out.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("assoc_score"), "pid"))).filter(F.col("_n") <= p.assoc_cap)
    return out.select("query_id", "pid", "hop", F.array_join("path", " → ").alias("reason"), "overlap", "assoc_score")


def schema_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, name, n: predicates that sanitise to another, and labels that are not allowed."""
    bad_edges = edges.groupBy("pred").agg(F.count("*").alias("n")).filter(sanitize_predicate(F.col("pred")) != F.col("pred")).select(F.lit("predicate").alias("kind"), F.col("pred").alias("name"), "n")
    bad_nodes = nodes.filter(F.col("label").isNull() | ~F.col("label").isin(S.LABELS)).groupBy("label").agg(F.count("*").alias("n")).select(F.lit("label").alias("kind"), F.coalesce("label", F.lit("<NULL>")).alias("name"), "n")
    return bad_edges.unionByName(bad_nodes)


def repaired(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with allowed labels and edges with allowed predicates; edges that became equal keep the newest."""
    e = edges.withColumn("pred", sanitize_predicate(F.col("pred")))
    one = W.partitionBy("subj", "pred", "obj").orderBy(F.desc_nulls_last("updated"), "eid")
    e = e.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    return nodes.withColumn("label", sanitize_label(F.col("label"))).distinct(), e


def anchors(kos: DataFrame) -> DataFrame:
    """pid, anchor: each record's first entity."""
    return kos.select("pid", F.try_element_at("entities", F.lit(1)).alias("anchor")).filter("anchor is not null")
