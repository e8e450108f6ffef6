"""Recall as one plan over all queries: gate, channels, fusion, boost, re-rank, cut."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import scoring as X
from palimpsest.functions.text import Segmenter, fusion_key, graph_filler, safe_names, scenario_ids, tokens
from palimpsest.operators import bm25, fusion, graph
from palimpsest.operators.dense import dense_top_k
from palimpsest.operators.gate import gate_reason
from palimpsest.params import DEFAULT, Params

ITEM = ("fkey", "importance", "ts", "entities")
#: Adds rerank_score to items (query_id, query: the query's text, summary, ...); null where the model fails.
Reranker = Callable[[DataFrame], DataFrame]
#: Texts (text) to texts with their vectors (text, embedding); texts without a vector may be left out.
TextModel = Callable[[DataFrame], DataFrame]
#: Any change of the graph channel's rows before fusion.
GraphHook = Callable[[DataFrame], DataFrame]


def items(memories: DataFrame, segment: Segmenter | None = None) -> bm25.Index:
    """The records as recall reads them, written once: pid, fkey, importance, ts, entities and the lexical index. Texts stay where they are."""
    return bm25.build(keyed(memories), segment=segment, keep=ITEM)


def channel(hits: DataFrame, memories: DataFrame, score: str, text: bool = False) -> DataFrame:
    """Channel rows of hits (query_id, pid, rank, score): with the fusion key (of records that have it, else of their summaries) and, if wanted, the summary."""
    held = memories if "fkey" in memories.columns else keyed(memories)
    columns = (*ITEM, *(["summary"] if text else []))
    return hits.join(held.select("pid", *columns), "pid").select("query_id", "pid", *columns, F.col(score).alias("score"), "rank")


def dense_channel(queries: DataFrame, memories: DataFrame, p: Params = DEFAULT, per: str | None = None, held: DataFrame | None = None, text: bool = False) -> DataFrame:
    """Channel rows of the dense search. With rank_order 'collection' ranks run through the collections one after another. held: `items`' documents."""
    hits = dense_top_k(queries, memories, p.vec_top_k, p.vec_floor, per)
    order = [F.asc(per)] if per and p.rank_order == "collection" else []
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order, F.desc("sim"), "pid"))
    return channel(hits.withColumn("rank", rank), memories if text or held is None else held, "sim", text)


def lexical_channel(queries: DataFrame, memories: DataFrame, p: Params = DEFAULT, index: bm25.Index | None = None, segment: Segmenter | None = None, text: bool = False) -> DataFrame:
    index = index or items(memories, segment)
    hits = bm25.search(queries, index, p=p, segment=segment)
    return channel(hits, index.docs if not text and "fkey" in index.docs.columns else memories, "norm_score", text)


def graph_names(queries: DataFrame, nodes: DataFrame, p: Params = DEFAULT, segment: Segmenter | None = None) -> DataFrame:
    """query_id, names: entities found in the query's words."""
    return graph.entity_search(queries, nodes, p, segment).groupBy("query_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def graph_channel(queries: DataFrame, nodes: DataFrame, edges: DataFrame, p: Params = DEFAULT, segment: Segmenter | None = None, model: TextModel | None = None, hook: GraphHook | None = None) -> DataFrame:
    """query_id, src, dst, pred, summary, rank and, with a model, graph_sim (the query's vector against the edge text's, 0 where there is none): the newest neighbours of the found entities."""
    found = graph.entity_search(queries, nodes, p, segment).select("query_id", "name")
    near = graph.expand_one(found, edges, p=p)
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("src", "n"))).select("query_id", "src", "dst", "pred", "summary", "rank")
    if model:
        sims = similarities(queries, near.select("query_id", "summary").distinct(), model)
        near = near.join(sims, ["query_id", "summary"], "left").withColumn("graph_sim", F.coalesce("sim", F.lit(0.0))).drop("sim")
    return hook(near) if hook else near


def similarities(queries: DataFrame, items: DataFrame, model: TextModel) -> DataFrame:
    """query_id, summary, sim of items (query_id, summary) whose text the model knows."""
    vectors = model(items.select(F.col("summary").alias("text")).distinct()).select(F.col("text").alias("summary"), F.col("embedding").alias("v"))
    both = items.join(vectors, "summary").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    return both.select("query_id", "summary", X.cosine(F.col("q"), F.col("v")).alias("sim"))


def key_reranker(items: DataFrame) -> DataFrame:
    """Stand-in for a cross-encoder where texts are not at hand: the fused key, mapped to 0..1."""
    return items.withColumn("rerank_score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("sort_key"))), 4))


def overlap_reranker(items: DataFrame) -> DataFrame:
    """A deterministic model-shaped scorer of (query, summary): the share of the query's distinct words that the summary has."""
    words = lambda c: F.array_distinct(F.transform(tokens(F.col(c), []), F.lower))
    q = words("query")
    return items.withColumn("rerank_score", F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, words("summary"))) / F.size(q), 4)).otherwise(0.0))


def rerank(items: DataFrame, model: Reranker | None = None, p: Params = DEFAULT, floor: float | None = None) -> DataFrame:
    """The best `rerank_top_k` of each query by a model's rerank_score, at the floor or above; rows without a score keep their fused key."""
    scored = (model or key_reranker)(items).withColumn("rerank_score", F.coalesce("rerank_score", "sort_key"))
    kept = scored.filter(F.col("rerank_score") >= (p.rerank_floor if floor is None else floor))
    return fusion.top(kept.drop("rank"), p.rerank_top_k, "rerank_score")


def upper_context(queries: DataFrame, uppers: DataFrame, p: Params = DEFAULT, k: int | None = None, floor: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits of the upper layers (query_id, pid, layer, score), the best k of each layer, and for each query their entities and scenarios (of L2 only)."""
    hits = dense_top_k(queries, uppers, k or p.rerank_top_k, p.upper_floor if floor is None else floor, per="layer").withColumnRenamed("sim", "score")
    held = hits.join(uppers.select("pid", "layer", "entities", "scenario_id", "title"), ["pid", "layer"])
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    of_scenario = F.when(F.col("layer") == "L2", scenario_ids(F.col("scenario_id"), F.col("title"))).otherwise(F.array().cast("array<string>"))
    context = held.withColumns({"_e": safe_names(F.col("entities")), "_s": of_scenario}).groupBy("query_id").agg(flat("_e").alias("entities"), flat("_s").alias("scenarios"))
    return hits.select("query_id", "pid", "layer", "score"), context


def seed_entities(queries: DataFrame, context: DataFrame, texts: DataFrame, segment: Segmenter | None = None) -> DataFrame:
    """query_id, names: the context's entities; for queries without any the words of the hits' texts (query_id, text); else the whole query."""
    words = texts.select("query_id", F.explode(tokens(F.col("text"), cjk=True, segment=segment)).alias("w")).groupBy("query_id").agg(F.array_sort(F.collect_set("w")).alias("words"))
    out = queries.select("query_id", "text").join(context.select("query_id", "entities"), "query_id", "left").join(words, "query_id", "left")
    some = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.col(c))
    return out.select("query_id", F.coalesce(some("entities"), some("words"), F.array(F.trim("text"))).alias("names"))


def lexical_upper(queries: DataFrame, memories: DataFrame, k: int, p: Params = DEFAULT, segment: Segmenter | None = None) -> DataFrame:
    """query_id, pid, rank, score: the best k records by lexical rank, scored by rank alone (the L0 channel)."""
    hits = bm25.search(queries, bm25.build(memories, segment=segment), k, p, segment=segment)
    return hits.select("query_id", "pid", "rank", X.rounded(X.rank_score(F.col("rank"))).alias("score"))


def gated(queries: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return queries.filter(gate_reason(F.col("text"), p) == "")


def recall(
    queries: DataFrame,
    memories: DataFrame,
    nodes: DataFrame | None = None,
    edges: DataFrame | None = None,
    p: Params = DEFAULT,
    algorithm: str | None = None,
    model: Reranker | None = None,
    layers: tuple[str, ...] | None = None,
    index: bm25.Index | None = None,
    segment: Segmenter | None = None,
    uppers: DataFrame | None = None,
) -> DataFrame:
    """query_id, rank, pid, fkey, channels, sort_key, rerank_score of all queries (query_id, text, embedding) that the gate lets pass.

    nodes: the graph's entities that a query names weigh on what the channels found (RRF only, as the arithmetic fusion takes no part in it).
    uppers: records of the upper layers (pid, layer, embedding, entities, scenario_id, title, linked_l1_pids), whose hits lead to L1 records.
    model: gets the text of the query and of the fused best of each, no others.
    """
    asked = gated(queries, p)
    held = memories.filter(F.col("layer").isin(*layers)) if layers else memories
    names = graph_names(asked, nodes, p, segment) if nodes is not None else None
    text = names is not None and (algorithm or fusion.current()) != "arithmetic"
    index = index or items(held, segment)
    vec, lex = dense_channel(asked, held, p, held=index.docs, text=text), lexical_channel(asked, held, p, index, segment, text)
    fused = fusion.fuse(vec, lex, names, p, algorithm)
    if uppers is not None:
        fused = with_resolved(fused, asked, uppers, held, p)
    best = fusion.top(fused, p.fused_top_k)
    if model:
        texts = held.select("pid", "summary")
        best = best.drop("summary").join(texts, "pid").join(asked.select("query_id", F.col("text").alias("query")), "query_id")
    out = rerank(best, model, p)
    return out.select("query_id", "rank", "pid", "fkey", "channels", "sort_key", "rerank_score")


def with_resolved(fused: DataFrame, queries: DataFrame, uppers: DataFrame, memories: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The fused items and, behind them, L1 records that upper-layer hits link to (channel 'upper', keyed by the better of both similarities)."""
    hits, _ = upper_context(queries, uppers, p)
    found = resolve_to_l1(hits, uppers, memories, queries, p)
    found = found.join(keyed(memories).select("pid", *ITEM), "pid").filter("fkey <> ''")
    found = found.join(fused.select("query_id", "fkey"), ["query_id", "fkey"], "left_anti")
    rows = found.select("query_id", "pid", *ITEM, F.lit("upper").alias("channels"), F.greatest("parent_score", "sim").alias("sort_key"))
    one = W.partitionBy("query_id", "fkey").orderBy(F.desc("sort_key"), "pid")
    rows = rows.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    return fused.unionByName(rows, allowMissingColumns=True)


def legacy_recall(
    queries: DataFrame,
    memories: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    p: Params = DEFAULT,
    segment: Segmenter | None = None,
    model: TextModel | None = None,
    hook: GraphHook | None = None,
    keyword_ratio: float = 0.0,
    keyword_min: int = 3,
) -> DataFrame:
    """query_id, summary, channels, score and, with a model, pid, sort_key, sim, is_weak: the older preset, for queries that skip the gate.

    Dense, lexical (after the soft keyword filter) and graph channels meet by whole summary in reciprocal ranks. With a model that embeds texts, edge summaries
    whose ends the query names expand it for a second dense pass (scores by 0.9, after the first), items of the graph channel that name a graph
    entity gain the boost, importance and age weigh, and only what is similar to the query itself stays: the best few, one for each pid, graph text that
    reads like a bare triple left out.
    """
    p1 = p.with_(vec_floor=min(p.vec_floor, p.legacy_vec_floor))
    vec = dense_channel(queries, memories, p1, text=True)
    lex = lexical_channel(queries, memories, p, segment=segment, text=True)
    if keyword_ratio:
        words = queries.select("query_id", tokens(F.col("text"), [], cjk=True, segment=segment).alias("_w"))
        has = F.exists("_w", lambda w: F.contains(F.col("summary"), w))
        lex = fusion.keyword_filter(lex.join(words, "query_id"), has, keyword_min, keyword_ratio).drop("_w")
    near = graph_channel(queries, nodes, edges, p, segment, hook=hook)
    if model is None:
        near = near.filter(graph_filler(F.col("summary")))
        return fusion.rrf_n({"vec": vec, "bm25": lex, "graph": near.select("query_id", "summary", "rank")}, p)

    again = dense_channel(embedded(prf_query(queries, near), model), memories, p1, text=True).withColumn("score", X.rounded(F.col("score") * 0.9))
    found = vec.groupBy("query_id").agg(F.max("rank").alias("_last"))
    again = again.join(found, "query_id", "left").withColumn("rank", F.col("rank") + F.coalesce("_last", F.lit(0))).drop("_last")
    vec = vec.unionByName(again)
    fused = fusion.rrf_n({"vec": vec, "bm25": lex, "graph": near.select("query_id", "summary", "rank")}, p).withColumn("sort_key", F.col("score"))
    names = near.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(F.array("src", "dst")))).alias("names"))
    fused = fusion.graph_boosted(fused, names, p)
    known = vec.select("query_id", "summary", "pid", "importance", "ts", F.lit(0).alias("c"), "rank").unionByName(lex.select("query_id", "summary", "pid", "importance", "ts", F.lit(1).alias("c"), "rank"))
    known = known.groupBy("query_id", F.md5(F.col("summary").cast("binary")).alias("_d")).agg(F.min_by(F.struct("pid", "importance", "ts"), F.struct("c", "rank", "pid")).alias("_r"))
    fused = fused.withColumn("_d", F.md5(F.col("summary").cast("binary"))).join(known, ["query_id", "_d"], "left").select("query_id", "summary", "channels", "score", "sort_key", F.col("_r.pid").alias("pid"), F.col("_r.importance").alias("importance"), F.col("_r.ts").alias("ts"))
    fused = fusion.post_fuse(fused, p).join(similarities(queries, fused.select("query_id", "summary"), model), ["query_id", "summary"])
    best = fusion.kg_verified(fused.withColumn("fkey", fusion_key(F.col("summary"))).filter("fkey <> ''"), p).drop("rank")
    one = W.partitionBy("query_id", F.coalesce("pid", F.concat(F.lit("key:"), "fkey"))).orderBy(F.desc("sort_key"), "fkey")
    best = best.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    best = best.filter(F.contains("channels", F.lit("vec")) | F.contains("channels", F.lit("bm25")) | graph_filler(F.col("summary")))
    return fusion.top(best, p.kg_top).select("query_id", "rank", "pid", "summary", "channels", "score", "sort_key", "sim", "is_weak")


def associations(queries: DataFrame, seeds: DataFrame, said: DataFrame, memories: DataFrame, edges: DataFrame, model: TextModel, p: Params = DEFAULT) -> DataFrame:
    """query_id, pid, hop, reason, overlap, assoc_score: what a query's seeds bring to mind.

    The seeds' names (query_id, names) spread over the graph; query, three seed summaries (said: query_id, n, summary) and fifteen names are embedded for a
    dense search, whose hits are scored by overlap, nearness, importance and age.
    """
    spread = graph.spread_names(seeds, edges, p)
    joined = lambda df, order, column: df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column]), " ").alias("_" + column))
    few = spread.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("pos"))).filter("_n <= 15")
    text = queries.select("query_id", "text").join(joined(few, "pos", "name"), "query_id").join(joined(said.filter("n <= 3"), "n", "summary"), "query_id", "left")
    asked = embedded(text.select("query_id", F.concat_ws(" ", "text", "_summary", "_name").alias("text")), model)
    hits = dense_top_k(asked, memories, p.assoc_cap, 0.0).select("query_id", "pid").join(memories.select("pid", "summary", "importance", "ts", "entities"), "pid").filter("summary <> ''")
    return graph.scored_associations(hits, spread, seeds, said, p)


def trace(stages: dict[str, DataFrame], key: str = "fkey", score: str = "score") -> DataFrame:
    """query_id, stage, n, first: how many items each stage of a recall left for a query, and the key of its best."""
    parts = []
    for k, (name, df) in enumerate(stages.items()):
        by = next(c for c in ("rerank_score", "sort_key", score) if c in df.columns)
        best = F.max_by(key, F.struct(F.col(by), F.col(key)))
        parts.append(df.groupBy("query_id").agg(F.count("*").alias("n"), best.alias("first")).select("query_id", F.lit(f"{k}-{name}").alias("stage"), "n", "first"))
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def embedded(queries: DataFrame, model: TextModel) -> DataFrame:
    """query_id, text, embedding of queries (query_id, text)."""
    vectors = model(queries.select("text").distinct())
    return queries.join(vectors.select("text", "embedding"), "text")


def prf_query(queries: DataFrame, near: DataFrame, most: int = 3) -> DataFrame:
    """query_id, text: queries that name an end of an edge of their graph channel, with the first `most` such edges' summaries behind them."""
    asked = near.join(queries.select("query_id", F.lower("text").alias("_t")), "query_id")
    named = lambda c: F.coalesce((F.col(c) != "") & F.contains(F.col("_t"), F.lower(c)), F.lit(False))
    asked = asked.filter((F.length("summary") >= 2) & (named("src") | named("dst")))
    first = asked.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(F.col("_n") <= most)
    added = first.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "summary"))), lambda x: x["summary"]), " ").alias("_a"))
    return queries.select("query_id", "text").join(added, "query_id").select("query_id", F.concat_ws(" ", "text", "_a").alias("text"))


def prf_expanded(queries: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """query_id, text: the query with up to three summaries of edges one of whose ends it names.

    A name meets every query that contains it, whatever stands around it.
    """
    e = edges.filter(graph.active()).withColumn("summary", graph.edge_summary())
    ends = e.select(F.explode(F.array("subj", "obj")).alias("name"), "summary").distinct().withColumn("inner", F.lower("name"))
    asked = queries.select("query_id", F.lower("text").alias("outer"))
    hit = graph.containing(ends.select("inner"), asked.select("outer")).join(asked, "outer").join(ends, "inner").select("query_id", "summary").distinct()
    hit = hit.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("summary"))).filter(F.col("n") <= most)
    added = hit.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "summary"))), lambda x: x["summary"]), " ").alias("added"))
    return queries.join(added, "query_id", "left").withColumn("text", F.concat_ws(" ", "text", "added")).drop("added")


def resolve_to_l1(hits: DataFrame, uppers: DataFrame, memories: DataFrame, queries: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """query_id, pid, parent_score, sim: L1 records behind upper-layer hits (query_id, pid, score), each with its best parent, that are near the query."""
    links = hits.join(uppers.select("pid", F.explode("linked_l1_pids").alias("l1")), "pid").groupBy("query_id", "l1").agg(F.max("score").alias("parent_score"))
    held = links.join(memories.filter("layer = 'L1' and embedding is not null").select(F.col("pid").alias("l1"), "embedding"), "l1").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    return held.withColumn("sim", X.cosine(F.col("q"), F.col("embedding"))).filter(F.col("sim") >= p.resolve_floor).select("query_id", F.col("l1").alias("pid"), "parent_score", "sim")


def payload_filter(memories: DataFrame, entities: Column | None = None, scenarios: list[str] | None = None) -> DataFrame:
    """Records that share an entity, or belong to a scenario by id or title."""
    keep = F.lit(False)
    if entities is not None:
        keep = keep | F.arrays_overlap("entities", entities)
    if scenarios:
        keep = keep | F.coalesce(F.col("scenario_id").isin(scenarios), F.lit(False)) | F.coalesce(F.col("title").isin(scenarios), F.lit(False))
    return memories.filter(F.coalesce(keep, F.lit(False)))


def tag_prefilter(items: DataFrame, tags: Column) -> DataFrame:
    """Items that share a tag with the query; without tags on either side all stay."""
    lower = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(x))
    return items.filter((F.size(lower(tags)) == 0) | (F.size(lower(F.col("tags"))) == 0) | F.arrays_overlap(lower(tags), lower(F.col("tags"))))


def injection(results: DataFrame, header: str = "[memories]") -> DataFrame:
    """query_id, block: header and summaries in order; queries without results get nothing."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "summary"))), lambda x: x["summary"])
    return results.filter("summary <> ''").groupBy("query_id").agg(ordered.alias("s")).select("query_id", F.concat(F.lit(header + "\n"), F.array_join("s", "\n")).alias("block"))


def keyed(items: DataFrame) -> DataFrame:
    return items.withColumn("fkey", fusion_key(F.col("summary")))
