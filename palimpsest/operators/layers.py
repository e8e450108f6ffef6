"""The four-layer write, batch writes, graph upserts and changes by query, as pure transformations: each returns the new rows and changes nothing.

Layers: L0 conversations, L1 records, L2 scenarios, L3 personas. Bundles (bundle_id) are what one conversation yields; identities are hashes of content, so
layers need no order and a rerun gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import scoring as X
from palimpsest.functions import text as T
from palimpsest.functions.scoring import clamp
from palimpsest.operators import writes
from palimpsest.operators.dense import dense_top_k
from palimpsest.params import DEFAULT, Params

#: Pairs (key, new_text, pid, old_text) to the same with `same` boolean; null where the model cannot tell.
Judge = Callable[[DataFrame], DataFrame]
LINK = ("src_layer", "src_id", "rel", "dst_layer", "dst_id")


def literal_judge(pairs: DataFrame) -> DataFrame:
    """The default: texts are the same if they are equal without white space and case."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    return pairs.withColumn("same", bare("new_text") == bare("old_text"))


def digest(c: Column) -> Column:
    return F.md5(T.strip(c).cast("binary"))


def literal_decisions(new: DataFrame, existing: DataFrame, candidates: DataFrame | None = None, judge: Judge | None = None) -> DataFrame:
    """key, action, match_pid, reason of L0 texts (key, text): SKIP where an existing text (pid, summary) or that of an earlier key is equal, CREATE else.

    candidates (key, pid, summary), few for each key, go to the judge where nothing is equal. Equal texts meet by digest, so no pair is made in vain.
    """
    held = new.select("key", T.strip(F.col("text")).alias("text")).filter("text <> ''").withColumn("_d", digest(F.col("text")))
    old = existing.select(digest(F.col("summary")).alias("_d"), "pid").groupBy("_d").agg(F.min("pid").alias("old_pid"))
    first = held.groupBy("_d").agg(F.min("key").alias("_first"))
    out = held.join(first, "_d").join(old, "_d", "left")
    equal = F.coalesce("old_pid", F.when(F.col("key") != F.col("_first"), F.col("_first").cast("string")))
    out = out.select("key", "text", equal.alias("match_pid"))
    if candidates is None:
        judged = out.withColumn("_judged", F.lit(None).cast("string"))
    else:
        pairs = out.filter("match_pid is null").join(candidates.select("key", "pid", F.col("summary").alias("old_text")), "key").select("key", F.col("text").alias("new_text"), "pid", "old_text")
        same = (judge or literal_judge)(pairs).filter("same").groupBy("key").agg(F.min("pid").alias("_judged"))
        judged = out.join(same, "key", "left")
    reason = F.when(F.col("match_pid").isNotNull(), "equal text").when(F.col("_judged").isNotNull(), "judged the same").otherwise("new text")
    match = F.coalesce("match_pid", "_judged")
    return judged.select("key", F.when(match.isNotNull(), "SKIP").otherwise("CREATE").alias("action"), match.alias("match_pid"), reason.alias("reason"))


def threshold_decisions(new: DataFrame, existing: DataFrame, p: Params = DEFAULT, k: int = 5) -> DataFrame:
    """key, action, match_pid, n_candidates of records (key, state, embedding) of any layer against existing ones (pid, embedding), by similarity alone."""
    hits = dense_top_k(new.select(F.col("key").alias("query_id"), "embedding"), existing, k, p.candidate_floor)
    best = hits.groupBy("query_id").agg(F.max("sim").alias("best"), F.min_by("pid", "rank").alias("match_pid"), F.count("*").alias("n_candidates"))
    out = new.select("key", "state").join(best, new.key == best.query_id, "left")
    action = X.dedup_action(F.coalesce("state", F.lit("active")), F.col("best"), p)
    return out.select("key", action.alias("action"), "match_pid", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def judged_decisions(new: DataFrame, existing: DataFrame, replies: DataFrame | None = None, p: Params = DEFAULT, k: int = 5) -> DataFrame:
    """As threshold_decisions, by a model's replies (key, reply); a reply that does not parse, or none, falls back to the rule without thresholds."""
    hits = dense_top_k(new.select(F.col("key").alias("query_id"), "embedding"), existing, k, p.candidate_floor)
    best = hits.groupBy("query_id").agg(F.min_by("pid", "rank").alias("match_pid"), F.count("*").alias("n_candidates"))
    out = new.select("key", "state").join(best, new.key == best.query_id, "left").drop("query_id")
    out = out.join(replies.select("key", T.decision_action(F.col("reply")).alias("_said")), "key", "left") if replies is not None else out.withColumn("_said", F.lit(None).cast("string"))
    action = F.coalesce("_said", X.dedup_fallback(F.coalesce("state", F.lit("active")), F.col("match_pid").isNotNull()))
    return out.select("key", action.alias("action"), "match_pid", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def invalidated(existing: DataFrame, decisions: DataFrame, now: datetime) -> DataFrame:
    """Existing records that an INVALIDATE decision names become uncertain."""
    hit = decisions.filter("action = 'INVALIDATE' and match_pid is not null").select(F.col("match_pid").alias("pid")).distinct().withColumn("_hit", F.lit(True))
    out = existing.join(hit, "pid", "left")
    return out.withColumns({"state": F.when(F.col("_hit"), "uncertain").otherwise(F.col("state")), "recorded_at": F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("recorded_at"))}).drop("_hit")


def decision_log(decisions: DataFrame, records: DataFrame, now: datetime) -> DataFrame:
    """The dedup_decisions rows: at, action, reason, summary (to 120), n_candidates of decisions (key, ...) on records (key, summary)."""
    reason = F.col("reason") if "reason" in decisions.columns else F.lit("")
    n = F.col("n_candidates") if "n_candidates" in decisions.columns else F.when(F.col("match_pid").isNull(), 0).otherwise(1)
    return decisions.join(records.select("key", "summary"), "key").select(F.lit(now).cast("timestamp").alias("at"), "action", reason.alias("reason"), F.substring("summary", 1, 120).alias("summary"), n.cast("long").alias("n_candidates"))


def append(rows: DataFrame, path: str, day: str = "at") -> None:
    """Appends to a log table partitioned by day; keeping it bounded is dropping old days."""
    rows.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").parquet(path)


def rolled(log: Column, keep: int = 256 * 1024) -> Column:
    """A Markdown log of more than `keep` bytes without its first half, from the next block on; 0 keeps everything."""
    half = F.floor(F.length(log) / 2).cast("int")
    rest = F.substring(log, half + 1, F.length(log))
    at = F.locate("\n### ", rest)
    cut = F.when(at > 0, F.substring(rest, at + 1, F.length(rest))).otherwise(rest)
    return F.when((F.octet_length(log) > keep) & (F.lit(keep) > 0), cut).otherwise(log)


def event_block(at: Column, event: Column, fields: Column) -> Column:
    """A Markdown block of an event: header, then one line a field, longer ones fenced (fields: map<string,string>, in key order)."""
    line = lambda k, v: F.when(F.contains(v, F.lit("\n")) | (F.length(v) > 80), F.concat(F.lit("- **"), k, F.lit("**:\n\n```\n"), v, F.lit("\n```\n"))).otherwise(F.concat(F.lit("- **"), k, F.lit("**: "), v, F.lit("\n")))
    lines = F.transform(F.array_sort(F.map_entries(F.map_filter(fields, lambda _, v: v.isNotNull()))), lambda e: line(e["key"], e["value"]))
    return F.concat(F.lit("### "), F.date_format(at, "HH:mm:ss"), F.lit(" "), event, F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n\n"))


@dataclass(frozen=True)
class Written:
    """What a write yields: decisions (key, action, match_pid, reason), records of all layers, relation points, graph rows, links between layers, counts by action."""

    decisions: DataFrame
    records: DataFrame
    relation_points: DataFrame
    nodes: DataFrame
    edges: DataFrame
    links: DataFrame
    report: DataFrame


RECORD = ("bundle_id", "layer", "pid", "collection", "memory_type", "summary", "title", "scenario_id", "state", "importance", "entities", "tags", "linked_l1_pids", "vector_text", "recorded_at")


def _names(entities: str) -> Column:
    return F.filter(F.transform(F.col(entities), lambda e: T.strip(F.coalesce(e["name"], F.lit("")))), lambda n: n != "")


def _records(df: DataFrame, **given: Column) -> DataFrame:
    none = F.array().cast("array<string>")
    types = {"importance": "double", "entities": "array<string>", "tags": "array<string>", "linked_l1_pids": "array<string>"}
    default = {"entities": none, "tags": none}
    return df.select(*[(given[c] if c in given else default.get(c, F.lit(None))).cast(types.get(c, "string")).alias(c) for c in RECORD])


def l1_records(kos: DataFrame, existing: DataFrame | None, now: str, p: Params = DEFAULT) -> DataFrame:
    """Cleaned records of bundles with identity; a record whose pid lives in another collection stays there, which counts as an update."""
    built = writes.build_l1(writes.clean_kos(kos, p), now)
    if existing is None:
        return built.withColumn("action", F.lit("create"))
    placed = writes.place(built, existing)
    known = existing.select("pid").distinct().withColumn("_there", F.lit(True))
    return placed.join(known, "pid", "left").withColumn("action", F.when(F.col("_there"), "update").otherwise("create")).drop("_there")


def write_layers(l0: DataFrame, kos: DataFrame, scenarios: DataFrame, personas: DataFrame, existing: DataFrame, now: datetime, p: Params = DEFAULT, candidates: DataFrame | None = None, judge: Judge | None = None) -> Written:
    """The ordered write of bundles. A bundle whose conversation text exists is skipped in all layers; others yield L1, and L0, L2, L3 linked to it.

    l0: bundle_id, scene_summary, source. kos: bundle_id, pos and a record's fields. scenarios: bundle_id, title, summary, type, state, importance, tags, entities.
    personas: bundle_id, summary, type, state, importance, tags. existing: pid, layer, collection, summary.
    """
    stamp = now.isoformat()
    said = l0.select(F.col("bundle_id").alias("key"), F.col("scene_summary").alias("text"))
    decisions = literal_decisions(said, existing.filter("layer = 'L0'"), candidates, judge)
    skipped = decisions.filter("action <> 'CREATE'").select(F.col("key").alias("bundle_id"))
    going = lambda df: df.join(skipped, "bundle_id", "left_anti")

    l1 = l1_records(going(kos), existing.filter("layer = 'L1'"), stamp, p)
    linked = l1.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pid"))), lambda x: x["pid"]).alias("linked_l1_pids"))
    with_links = lambda df: going(df).join(linked, "bundle_id", "left").withColumn("linked_l1_pids", F.coalesce("linked_l1_pids", F.array().cast("array<string>")))
    text = lambda c: T.strip(F.coalesce(F.col(c), F.lit("")))

    c = with_links(l0).withColumn("_s", text("scene_summary")).filter("_s <> ''").withColumn("_pid", T.layer_pid(F.lit("L0"), F.concat_ws("|", F.col("bundle_id").cast("string"), "_s")))
    rec0 = _records(c, bundle_id=F.col("bundle_id"), layer=F.lit("L0"), pid=F.col("_pid"), collection=F.lit("memory_l0"), memory_type=F.lit("l0_conversation"), summary=F.col("_s"), linked_l1_pids=F.col("linked_l1_pids"), vector_text=F.col("_s"), recorded_at=F.lit(stamp))
    rec1 = _records(l1, bundle_id=F.col("bundle_id"), layer=F.lit("L1"), pid=F.col("pid"), collection=F.col("collection"), memory_type=F.coalesce("type", F.lit("fact")), summary=F.col("summary"), state=F.col("state"), importance=F.col("importance"), entities=F.transform("entities", lambda e: e["name"]), tags=F.col("tags"), vector_text=F.col("vector_text"), recorded_at=F.lit(stamp))

    s = with_links(scenarios).withColumns({"_t": text("title"), "_s": text("summary")}).filter("_t <> '' or _s <> ''")
    s = s.withColumn("_sid", F.when(F.col("_t") != "", F.col("_t")).otherwise(F.substring("_s", 1, 50))).withColumn("_names", _names("entities"))
    rec2 = _records(
        s, bundle_id=F.col("bundle_id"), layer=F.lit("L2"), pid=T.layer_pid(F.lit("L2"), F.col("_sid")), collection=F.lit("memory_scenario"), memory_type=F.lit("scenario"), summary=F.when(F.col("_s") != "", F.col("_s")).otherwise(F.col("_t")), title=F.col("_t"), scenario_id=F.col("_sid"),
        state=F.coalesce("state", F.lit("historical")), importance=F.coalesce("importance", F.lit(0.7)), entities=F.col("_names"), tags=F.col("tags"), linked_l1_pids=F.col("linked_l1_pids"), vector_text=T.strip(F.concat_ws(" ", "_t", "_s", F.array_join("_names", " "))), recorded_at=F.lit(stamp),
    )
    v = with_links(personas).withColumn("_s", text("summary")).filter("_s <> ''")
    rec3 = _records(v, bundle_id=F.col("bundle_id"), layer=F.lit("L3"), pid=T.layer_pid(F.lit("L3"), F.col("_s")), collection=F.lit("memory_persona"), memory_type=F.lit("persona"), summary=F.col("_s"), state=F.coalesce("state", F.lit("active")), importance=F.coalesce("importance", F.lit(0.8)), tags=F.col("tags"), linked_l1_pids=F.col("linked_l1_pids"), vector_text=F.col("_s"), recorded_at=F.lit(stamp))
    records = rec0.unionByName(rec1).unionByName(rec2).unionByName(rec3)

    link = lambda df, *values: df.select(*[(F.lit(x) if isinstance(x, str) else x).cast("string").alias(n) for n, x in zip(LINK, values, strict=True)])
    each = lambda df, pid: df.select(pid.alias("_id"), F.explode("linked_l1_pids").alias("_l1"))
    anchors = l1.filter(text("summary") != "").select("bundle_id", F.try_element_at(_names("entities"), F.lit(1)).alias("_a")).filter("_a is not null").join(c.select("bundle_id", "_pid"), "bundle_id").select("_pid", "_a").distinct()
    involved = s.select("_sid", F.explode("_names").alias("_n")).distinct()
    links = link(each(c, F.col("_pid")), "L0", F.col("_id"), "L0_GENERATED", "L1", F.col("_l1"))
    links = links.unionByName(link(anchors, "L0", F.col("_pid"), "GENERATED", "entity", F.col("_a")))
    links = links.unionByName(link(each(s, F.col("_sid")), "L1", F.col("_l1"), "BELONGS_TO", "L2", F.col("_id")))
    links = links.unionByName(link(involved, "L2", F.col("_sid"), "INVOLVES", "entity", F.col("_n")))
    links = links.unionByName(link(each(v, T.layer_pid(F.lit("L3"), F.col("_s"))), "L1", F.col("_l1"), "DESCRIBES", "L3", F.col("_id"))).distinct()

    nodes, edges = writes.graph_of(l1)
    named = s.select(F.explode("entities").alias("e")).select(T.strip(F.col("e.name")).alias("name"), T.sanitize_label(F.col("e.label")).alias("label"), F.lit(stamp).alias("recorded_at")).filter("name <> ''")
    nodes = writes.newest(nodes.unionByName(named), ["name"], [F.desc("recorded_at"), F.asc("label")])
    report = write_report(l1.select("action").unionByName(decisions.filter("action <> 'CREATE'").select(F.lit("skipped").alias("action"))))
    return Written(decisions, records, writes.relation_points(l1), nodes, edges, links, report)


def write_report(actions: DataFrame) -> DataFrame:
    """action, n of writes (action), with a row of 0 for each kind that did not occur."""
    kinds = ("create", "update", "override", "skipped", "errors")
    zero = actions.sparkSession.createDataFrame([(k,) for k in kinds], "action string").withColumn("n", F.lit(0).cast("long"))
    return zero.unionByName(actions.groupBy("action").agg(F.count("*").alias("n"))).groupBy("action").agg(F.sum("n").alias("n"))


def upsert_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a merge. nodes: name, label, updated; edges: subj, pred, obj, status, source, created, updated.

    A node is merged by label and name. An edge is created only if both ends are nodes; one that exists takes the new status, source and time and keeps its creation.
    """
    at = F.lit(now).cast("timestamp")
    merged = nodes.select("name", "label", "updated").unionByName(new_nodes.select(T.strip(F.col("name")).alias("name"), T.sanitize_label(F.col("label")).alias("label"), at.alias("updated")).filter("name <> ''"))
    merged = merged.groupBy("label", "name").agg(F.max("updated").alias("updated"))
    ends = merged.select("name").distinct()
    fresh = new_edges.select(T.strip(F.col("subj")).alias("subj"), T.sanitize_predicate(F.col("pred")).alias("pred"), T.strip(F.col("obj")).alias("obj"), F.coalesce("status", F.lit("active")).alias("status"), F.coalesce("source", F.lit("")).alias("source")).filter("subj <> '' and obj <> ''")
    fresh = fresh.join(ends.select(F.col("name").alias("subj")), "subj", "left_semi").join(ends.select(F.col("name").alias("obj")), "obj", "left_semi")
    # Of several new edges of one triple the last in the order of their values wins, whatever order they come in.
    fresh = fresh.groupBy("subj", "pred", "obj").agg(F.max(F.struct("status", "source")).alias("_new"))
    both = edges.join(fresh, ["subj", "pred", "obj"], "full_outer")
    hit = F.col("_new").isNotNull()
    out = both.withColumns({"created": F.when(F.col("updated").isNull() & F.col("created").isNull() & hit, at).otherwise(F.col("created")), "status": F.when(hit, F.col("_new.status")).otherwise(F.col("status")), "source": F.when(hit, F.col("_new.source")).otherwise(F.col("source")), "updated": F.when(hit, at).otherwise(F.col("updated"))})
    return merged, out.drop("_new")


def override(memories: DataFrame, edges: DataFrame, new: DataFrame, at: datetime) -> tuple[DataFrame, DataFrame]:
    """Records (pid, summary, ...) replaced by new ones (pid, summary, relations), and edges with the new triples in the place of those they close.

    A replaced record says what it supersedes (summary to 200, ts); its old form stays as a history record, marked, under a pid of its own.
    """
    now = F.lit(at).cast("timestamp")
    fresh = new.groupBy("pid").agg(F.max("summary").alias("_new"))
    held = memories.join(fresh, "pid", "left")
    changed = F.col("_new").isNotNull()
    supersedes = F.when(changed, F.struct(F.substring("summary", 1, 200).alias("summary"), F.col("ts").alias("ts")))
    current = held.withColumns({"supersedes": supersedes, "superseded_by": F.lit(None).cast("string"), "summary": F.coalesce("_new", "summary"), "ts": F.when(changed, now).otherwise(F.col("ts"))})
    history = held.filter(changed).withColumns({"supersedes": F.lit(None).cast(current.schema["supersedes"].dataType), "superseded_by": F.substring("_new", 1, 200), "pid": F.concat("pid", F.lit("_hist_"), F.substring(F.md5(F.col("_new").cast("binary")), 1, 8))})
    triples = new.select("summary", F.explode("relations").alias("r")).select(T.strip(F.col("r.subject")).alias("subj"), T.sanitize_predicate(F.col("r.predicate")).alias("pred"), T.strip(F.col("r.object")).alias("obj"), "summary").filter("subj <> '' and obj <> ''")
    closed = writes.supersede(edges, triples, at)
    added = triples.groupBy("subj", "pred", "obj").agg(F.max("summary").alias("ko_summary")).withColumns({"status": F.lit("active"), "updated": now})
    return current.unionByName(history).drop("_new"), closed.unionByName(added, allowMissingColumns=True)


def dispatched(kos: DataFrame, decisions: DataFrame | None, existing: DataFrame, now: str, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch write of records (key and a record's fields) after decisions (key, action): the records to write (with pid and action), (pid, action) of all, counts.

    SKIP, DISCARD and INVALIDATE write nothing; CREATE, UPDATE and anything unknown do. Without decisions everything is created.
    """
    built = l1_records(kos, existing, now, p)
    asked = built.join(decisions.select("key", F.col("action").alias("_said")), "key", "left") if decisions is not None else built.withColumn("_said", F.lit("CREATE"))
    stop = F.coalesce(F.col("_said").isin("SKIP", "DISCARD", "INVALIDATE"), F.lit(False))
    out = asked.withColumn("action", F.when(stop, "skipped").otherwise(F.col("action"))).drop("_said")
    return out.filter("action <> 'skipped'"), out.select("key", "pid", "action"), write_report(out.select("action"))


def soft_deleted(records: DataFrame, links: DataFrame, pids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (pid, layer, scenario_id, status) and links (LINK, status) after a soft delete of upper-layer records by pid.

    Scenarios and personas become deleted, a scenario's outgoing links too; of conversations the links to entities become deleted and the record goes.
    """
    gone = pids.select("pid").distinct().withColumn("_gone", F.lit(True))
    held = records.join(gone, "pid", "left")
    dead = held.filter("_gone and layer in ('L0', 'L2')").select(F.col("layer").alias("src_layer"), F.when(F.col("layer") == "L2", F.col("scenario_id")).otherwise(F.col("pid")).alias("src_id")).distinct().withColumn("_dead", F.lit(True))
    out_links = links.join(dead, ["src_layer", "src_id"], "left")
    marks = F.col("_dead") & ((F.col("src_layer") == "L2") | (F.col("rel") == "GENERATED"))
    detached = F.coalesce(F.col("_dead") & (F.col("src_layer") == "L0") & (F.col("rel") != "GENERATED"), F.lit(False))
    out_links = out_links.filter(~detached).withColumn("status", F.when(marks, "deleted").otherwise(F.col("status"))).drop("_dead")
    kept = held.filter(~F.coalesce(F.col("_gone") & (F.col("layer") == "L0"), F.lit(False)))
    return kept.withColumn("status", F.when(F.col("_gone") & F.col("layer").isin("L2", "L3"), "deleted").otherwise(F.col("status"))).drop("_gone"), out_links


def target_of(results: DataFrame) -> DataFrame:
    """query_id, pid, summary (to 120) of each query's best result (query_id, rank, pid, summary)."""
    best = writes.newest(results, ["query_id"], [F.asc("rank")])
    return best.select("query_id", "pid", F.substring("summary", 1, 120).alias("summary"))


def delete_by_query(results: DataFrame, memories: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories and edges after deleting each query's best result, by exactly its summary's first 120 characters (longer summaries stay, as these differ)."""
    return writes.delete_by_summary(memories, edges, target_of(results).select("summary"))


def located(targets: DataFrame, memories: DataFrame, model: Callable[[DataFrame], DataFrame], floor: float = 0.61, k: int = 3) -> DataFrame:
    """query_id, pid, collection: for each target's summary the record that is nearest to its vector, over all collections, at the floor or above."""
    texts = targets.select("query_id", F.col("summary").alias("text"))
    asked = texts.join(model(texts.select("text").distinct()).select("text", "embedding"), "text")
    hits = dense_top_k(asked, memories, k, floor, per="collection")
    return writes.newest(hits, ["query_id"], [F.desc("sim"), F.asc("pid")]).select("query_id", "pid", "collection")


def update_by_query(results: DataFrame, new: DataFrame, memories: DataFrame, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Memories merged with each query's new record (query_id, summary, entities, tags, evidence) at the record its best result is located at."""
    at = located(target_of(results), memories, model)
    change = at.join(new, "query_id").select("pid", "summary", "entities", "tags", "evidence")
    one = writes.newest(change, ["pid"], [F.asc("summary")])
    return writes.merge_update(memories.select("pid", "summary", "entities", "tags", "evidence"), one)


def relation_times(rel: Column, ko_event: Column, ko_valid: Column) -> Column:
    """The seven time fields of a relation (event_time, valid_time), with its record's where it has none."""
    et, vt = F.coalesce(rel["event_time"], ko_event), F.coalesce(rel["valid_time"], ko_valid)
    said = lambda c, default: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(F.lit(default))
    return F.struct(
        et["start"].alias("event_time_start"), et["end"].alias("event_time_end"), F.coalesce(et["expression"], F.lit("")).alias("event_time_expression"), said(et["precision"], "unknown").alias("event_time_precision"),
        vt["start"].alias("valid_time_start"), vt["end"].alias("valid_time_end"), said(vt["end_type"], "open").alias("valid_time_end_type"),
    )
