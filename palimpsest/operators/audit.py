"""Hygiene checks over records and graph. Each is one DataFrame; `report` puts their counts together."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import schemas as S
from palimpsest.functions.text import sanitize_predicate, strip
from palimpsest.operators.graph import active


def duplicate_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(active()).groupBy("subj", "pred", "obj").agg(F.count("*").alias("cnt")).filter("cnt > 1")


def duplicate_edge_groups(edges: DataFrame) -> DataFrame:
    """subj, pred, obj, copies of active triples stated more than once: each copy's updated and eid, the newest first."""
    copies = F.reverse(F.array_sort(F.collect_list(F.struct("updated", "eid"))))
    return edges.filter(active()).groupBy("subj", "pred", "obj").agg(copies.alias("copies")).filter(F.size("copies") > 1)


def cross_collection(memories: DataFrame) -> DataFrame:
    """Summaries that stand in more than one collection. Summaries group by their digest, so no long text is a shuffle key."""
    held = memories.filter("summary <> ''").select(F.md5(F.col("summary").cast("binary")).alias("digest"), "collection").distinct()
    return held.groupBy("digest").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("collection")), ",").alias("collections")).filter("n > 1")


def reconcile(nodes: DataFrame, edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Entities, relations, points, relations per point and its band."""
    e, r, m = nodes.agg(F.count_distinct("name").alias("entities")), edges.agg(F.count("*").alias("relations")), memories.agg(F.count("*").alias("points"))
    ratio = F.round(F.col("relations") / F.col("points"), 4)
    return e.crossJoin(r).crossJoin(m).withColumn("ratio", ratio).withColumn("band", F.when(F.col("ratio") > 1.5, "high").when(F.col("ratio") < 0.7, "low").otherwise("ok"))


def predicate_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("pred").agg(F.count("*").alias("n")).withColumn("allowed", F.col("pred").isin(S.PREDICATES)).withColumn("should_be", sanitize_predicate(F.col("pred")))


def label_histogram(nodes: DataFrame) -> DataFrame:
    per = nodes.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    return per.groupBy("labels").agg(F.count("*").alias("n"))


def source_distribution(edges: DataFrame, top: int = 20) -> DataFrame:
    some = lambda c: F.coalesce(c, F.lit("<NULL>"))
    return edges.groupBy(some(F.col("source")).alias("source"), some(F.col("ko_summary")).alias("ko_summary")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "ko_summary").limit(top)


def dead_superseded(edges: DataFrame) -> DataFrame:
    return edges.filter("status = 'superseded' and coalesce(superseded_by, '') = ''")


def occurring(strings: DataFrame, texts: DataFrame, block: int = 50_000) -> DataFrame:
    """The strings (s) that occur in any text (t). Blocks of a bounded number of strings pass over the texts, each as one automaton; every batch gives a string once."""
    import ahocorasick

    asked, found = strings.select("s").distinct().filter("s <> ''"), None
    names = (r.s for r in asked.toLocalIterator())
    while held := list(islice(names, block)):
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, name in enumerate(held):
            machine.add_word(name, k)
        machine.make_automaton()
        shared = texts.sparkSession.sparkContext.broadcast((machine, held))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine, held = shared.value
            for b in batches:
                seen = {k for t in b.column(0).to_pylist() if t for _, k in machine.iter(t)}
                yield pa.RecordBatch.from_pydict({"s": pa.array([held[k] for k in sorted(seen)], pa.string())})

        part = texts.select("t").mapInArrow(run, "s string")
        found = part if found is None else found.unionByName(part)
    return found.distinct() if found is not None else asked


def orphan_edges(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Active edges that no record backs: not by their summary, not by a source that occurs in a summary, not by both ends among the records' entities."""
    summary = strip(F.coalesce("summary", F.lit("")))
    said = memories.select(summary.alias("t")).filter("t <> ''")
    names = memories.select(F.explode("entities").alias("name")).distinct()
    digests = said.select(F.md5(F.col("t").cast("binary")).alias("_d")).distinct()
    held = edges.filter(active()).withColumn("_d", F.md5(F.col("ko_summary").cast("binary"))).join(digests, "_d", "left_anti").drop("_d")
    sources = occurring(held.select(F.col("source").alias("s")), said)
    held = held.join(sources.withColumnRenamed("s", "source"), "source", "left_anti")
    ends = held.join(names.select(F.col("name").alias("subj"), F.lit(True).alias("_s")), "subj", "left").join(names.select(F.col("name").alias("obj"), F.lit(True).alias("_o")), "obj", "left")
    return ends.filter(~(F.coalesce("_s", F.lit(False)) & F.coalesce("_o", F.lit(False)))).drop("_s", "_o")


def entity_difference(nodes: DataFrame, memories: DataFrame) -> DataFrame:
    """side, name: names that only the graph, or only the records have."""
    g, v = nodes.select("name").distinct(), memories.select(F.explode("entities").alias("name")).distinct()
    return g.join(v, "name", "left_anti").select(F.lit("graph").alias("side"), "name").unionByName(v.join(g, "name", "left_anti").select(F.lit("vector").alias("side"), "name"))


def report(checks: dict[str, DataFrame], sample: int = 30) -> tuple[DataFrame, dict[str, DataFrame]]:
    """check, n for all checks, and a sample of each."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, counts), {name: df.limit(sample) for name, df in checks.items()}


QUALITY = ("vec_hits", "graph_hits", "fused_n", "kg_pass_n", "vec_only", "graph_only", "both")


def recall_statistics(events: DataFrame, hours: float | None = None, now=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals (one row), skip reasons (reason, n) and the ten most frequent anchors (anchor, n) of a recall log.

    events: ts, event, reason, quality (struct of QUALITY), n_memories, anchors (array), config. hours: only the last hours before `now`; events without a
    time count always.
    """
    if hours:
        events = events.filter(F.col("ts").isNull() | (F.col("ts").cast("double") >= F.lit(now).cast("timestamp").cast("double") - hours * 3600))
    skipped, injected = F.col("event") == "recall_skipped", F.col("event") == "recall_injected"
    total = lambda c: F.coalesce(F.sum(F.when(injected, c)), F.lit(0))
    sums = [total(F.col(f"quality.{q}")).alias(q) for q in QUALITY]
    out = events.agg(
        F.count("*").alias("total"), F.count_if(skipped).alias("skipped"), F.count_if(injected).alias("injected"), *sums, total(F.col("n_memories")).alias("memories"),
        total(F.size(F.coalesce("anchors", F.array().cast("array<string>")))).alias("triples"), F.max_by("config", F.when(F.col("event") == "config_dump", F.coalesce("ts", F.lit("1970-01-01").cast("timestamp")))).alias("last_config"),
    )
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 3)
    out = out.withColumns({"skip_ratio": share("skipped", "total"), "inject_ratio": share("injected", "total"), "kg_pass_ratio": share("kg_pass_n", "fused_n")})
    reasons = events.filter(skipped).groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))
    anchors = events.filter(injected).select(F.explode("anchors").alias("anchor")).filter("anchor <> ''").groupBy("anchor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "anchor").limit(10)
    return out, reasons, anchors


def mean_overlap(items: DataFrame) -> DataFrame:
    """query_id, overlap: the mean overlap of each query's results (query_id, overlap)."""
    return items.groupBy("query_id").agg(F.round(F.avg(F.coalesce("overlap", F.lit(0.0))), 3).alias("overlap"))
