"""Ingest and mutations as pure transformations: every function returns the new state and changes nothing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.scoring import clamp
from palimpsest.params import DEFAULT, Params


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str] | None = None, version: str = "recorded_at", tie: str | None = None) -> DataFrame:
    """Last writer wins by key; of equal versions the change wins, then the larger tie column."""
    keys = keys or ["collection", "pid"]
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = [F.desc_nulls_last(version), F.desc("_new")] + ([F.desc_nulls_last(tie)] if tie else [])
    return newest(both, keys, order).drop("_new")


def place(new: DataFrame, existing: DataFrame, order: list[str] | None = None) -> DataFrame:
    """A pid that lives in another collection stays there; of several, the first in the order (else by name)."""
    rank = F.coalesce(*[F.when(F.col("collection") == c, i) for i, c in enumerate(order)], F.lit(len(order))) if order else F.lit(0)
    held = existing.groupBy("pid").agg(F.min_by("collection", F.struct(rank, F.col("collection"))).alias("_held"))
    return new.join(held, "pid", "left").withColumn("collection", F.coalesce("_held", "collection")).drop("_held")


def merge_update(old: DataFrame, new: DataFrame) -> DataFrame:
    """pid, summary, entities, tags, evidence, merged_from, action: ordered unions (old first), joined summaries and evidence; no old: created."""
    o = old.select("pid", *[F.col(c).alias(f"o_{c}") for c in ("summary", "entities", "tags", "evidence")])
    both = o.join(new.select("pid", "summary", "entities", "tags", "evidence"), "pid", "full_outer")
    none = F.array().cast("array<string>")
    union = lambda c: F.array_distinct(F.concat(F.coalesce(f"o_{c}", none), F.coalesce(c, none)))
    said = lambda c: F.when(F.col(c) != "", F.col(c))
    summary = F.when(said("o_summary").isNotNull() & said("summary").isNotNull() & (F.col("o_summary") != F.col("summary")), F.concat_ws(" | ", "o_summary", "summary")).otherwise(F.coalesce(said("summary"), said("o_summary"), F.lit("")))
    action = F.when(F.col("o_summary").isNull(), "create").when(F.col("summary").isNull(), "keep").otherwise("update")
    return both.select("pid", summary.alias("summary"), union("entities").alias("entities"), union("tags").alias("tags"), F.concat_ws(" | ", said("o_evidence"), said("evidence")).alias("evidence"), F.when(action == "update", F.substring("o_summary", 1, 100)).alias("merged_from"), action.alias("action"))


def supersede(edges: DataFrame, override: DataFrame, at: datetime) -> DataFrame:
    """Active edges whose triple is overridden close: status superseded, by the new summary, at that time. override: subj, pred, obj, summary."""
    one = override.groupBy("subj", "pred", "obj").agg(F.max("summary").alias("_by"))
    out = edges.join(one, ["subj", "pred", "obj"], "left")
    close = F.col("_by").isNotNull() & (F.coalesce("status", F.lit("active")) == "active")
    return out.withColumns(
        {
            "superseded_by": F.when(close, F.substring("_by", 1, 200)).otherwise(F.col("superseded_by")),
            "superseded_at": F.when(close, F.lit(at)),
            "status": F.when(close, "superseded").otherwise(F.col("status")),
        }
    ).drop("_by")


def cascade_delete(memories: DataFrame, pids: DataFrame) -> DataFrame:
    """Without the given L1 records and without every record of another layer that links to one of them."""
    linked = memories.filter("layer <> 'L1'").select("pid", F.explode("linked_l1_pids").alias("l1"))
    gone = linked.join(pids.select(F.col("pid").alias("l1")), "l1", "left_semi").select("pid").unionByName(pids.select("pid")).distinct()
    return memories.join(gone, "pid", "left_anti")


def delete_by_summary(memories: DataFrame, edges: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with exactly one of the summaries go; edges that carry it become deleted."""
    gone = summaries.select("summary").distinct()
    kept = memories.join(gone, "summary", "left_anti")
    return kept, mark_deleted(edges, gone.select(F.col("summary").alias("ko_summary")), "ko_summary")


def mark_deleted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Soft delete of the rows whose key is listed."""
    return rows.join(keys.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left").withColumn("status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))).drop("_gone")


def delete_by_pids(memories: DataFrame, edges: DataFrame, pids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records go; of the edges only those that carry a deleted record's summary become deleted."""
    gone = pids.select("pid").distinct()
    summaries = memories.join(gone, "pid", "left_semi").select(F.col("summary").alias("ko_summary")).filter("ko_summary <> ''")
    return memories.join(gone, "pid", "left_anti"), mark_deleted(edges, summaries, "ko_summary")


def keep_latest_edges(edges: DataFrame) -> DataFrame:
    """Of each triple only the edge that was updated last."""
    return newest(edges, ["subj", "pred", "obj"], [F.desc_nulls_last("updated"), F.asc("eid")])


def supersede_duplicates(edges: DataFrame) -> DataFrame:
    """Of each active triple the most complete edge stays (with a summary first, then the newest); the others point to it."""
    act = F.coalesce("status", F.lit("active")) == "active"
    has = F.coalesce(F.col("ko_summary") != "", F.lit(False))
    order = W.partitionBy("subj", "pred", "obj", act).orderBy(F.desc(has), F.desc_nulls_last("updated"), "eid")
    out = edges.withColumn("_n", F.row_number().over(order)).withColumn("_keep", F.first("ko_summary").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    lost = act & (F.col("_n") > 1)
    return out.withColumns({"status": F.when(lost, "superseded").otherwise(F.col("status")), "superseded_by": F.when(lost, F.substring(F.coalesce("_keep", F.lit("")), 1, 200)).otherwise(F.col("superseded_by"))}).drop("_n", "_keep")


def drop_long_text(edges: DataFrame, columns: tuple[str, ...] = ("summary", "ko_summary")) -> tuple[DataFrame, DataFrame]:
    """Edges without their long texts, and how many had each."""
    there = [c for c in columns if c in edges.columns]
    return edges.drop(*there), edges.agg(*[F.count(c).alias(f"n_{c}") for c in there])


def clean_kos(kos: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Records without dirty entities and the relations that touch them; records without a summary, or without entities and relations, go.

    entities: array<struct<name,label>>; relations: array<struct<subject,predicate,object,status>>.
    """
    ents = F.filter(F.coalesce("entities", F.array().cast(kos.schema["entities"].dataType)), lambda e: ~T.dirty_entity(e["name"], p.max_entity_len))
    rels = F.filter(F.coalesce("relations", F.array().cast(kos.schema["relations"].dataType)), lambda r: ~T.dirty_entity(r["subject"], p.max_entity_len) & ~T.dirty_entity(r["object"], p.max_entity_len))
    out = kos.withColumns({"entities": ents, "relations": rels})
    return out.filter((T.strip(F.coalesce("summary", F.lit(""))) != "") & ((F.size("entities") > 0) | (F.size("relations") > 0)))


def build_l1(kos: DataFrame, now: str) -> DataFrame:
    """Cleaned records with identity, vector text, clamped importance, collection and normalised times."""
    names = F.transform("entities", lambda e: e["name"])
    return kos.withColumns(
        {
            "pid": T.fact_pid(T.fact_fingerprint(names, F.col("relations"))),
            "collection": F.concat(F.lit("memory_"), F.coalesce("type", F.lit("fact"))),
            "vector_text": T.vector_text(F.col("summary"), names, F.col("relations")),
            "importance": clamp(F.col("importance")),
            "recorded_at": F.lit(now),
            "event_time": T.event_time_defaults(F.col("event_time")),
            "valid_time": T.valid_time_defaults(F.col("valid_time")),
        }
    )


def relation_points(l1: DataFrame) -> DataFrame:
    """A second point for each record with relations, from its triples alone."""
    text = T.relation_text(F.col("relations"))
    held = l1.filter(F.size("relations") > 0)
    return held.select(T.relation_pid(F.col("pid"), text).alias("pid"), F.lit("relation").alias("point_type"), F.col("pid").alias("parent_pid"), F.col("summary").alias("parent_summary"), text.alias("vector_text"), "collection")


def graph_of(l1: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges that the records state; labels and predicates sanitised; one row for each name and triple."""
    e = l1.select("pid", "summary", "recorded_at", F.explode("entities").alias("e")).select(F.col("e.name").alias("name"), T.sanitize_label(F.col("e.label")).alias("label"), "recorded_at")
    r = l1.select("pid", "summary", "recorded_at", F.explode("relations").alias("r"))
    r = r.select(F.col("r.subject").alias("subj"), T.sanitize_predicate(F.col("r.predicate")).alias("pred"), F.col("r.object").alias("obj"), F.coalesce("r.status", F.lit("active")).alias("status"), F.col("summary").alias("ko_summary"), F.col("recorded_at").alias("updated"), "pid")
    return newest(e, ["name"], [F.desc("recorded_at"), F.asc("label")]), newest(r, ["subj", "pred", "obj"], [F.desc("updated"), F.asc("pid")]).drop("pid")


def links_of(upper: DataFrame) -> DataFrame:
    """src_layer, src_id, rel, dst_layer, dst_id: provenance of upper-layer records (pid, layer, linked_l1_pids)."""
    rel = F.when(F.col("layer") == "L0", "L0_GENERATED").when(F.col("layer") == "L2", "INVOLVES").otherwise("DESCRIBES")
    return upper.select(F.col("layer").alias("src_layer"), F.col("pid").alias("src_id"), rel.alias("rel"), F.lit("L1").alias("dst_layer"), F.explode("linked_l1_pids").alias("dst_id"))


def runtime_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old records first; a new one enters only under a key that is not yet there. Both have `pos`, their place in the list."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return newest(both, keys, [F.asc("_new"), F.asc("pos")]).withColumnRenamed("_new", "is_new")


def issue_tokens(candidates: DataFrame, action: str, now: datetime, p: Params = DEFAULT) -> DataFrame:
    """First phase: one pending action for each query with its candidates (query_id, pid, layer, summary)."""
    held = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pid", "layer", "summary"))).alias("candidates"))
    return held.select(F.md5(F.concat_ws("|", F.lit(action), F.col("query_id").cast("string"), F.lit(now.isoformat()))).alias("token"), F.lit(action).alias("action"), "query_id", "candidates", (F.lit(now).cast("timestamp") + F.expr(f"INTERVAL {p.token_ttl_seconds} SECONDS")).alias("expires_at"))


def confirm(tokens: DataFrame, token: str, now: datetime) -> DataFrame:
    """Second phase: the pids of a token that has not expired."""
    return tokens.filter((F.col("token") == token) & (F.col("expires_at") > F.lit(now))).select(F.explode("candidates").alias("c")).select("c.pid", "c.layer")
