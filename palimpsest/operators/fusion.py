"""Rank fusion of dense, lexical and graph channels, with a registry of algorithms.

Channels are DataFrames (query_id, pid, importance, ts, entities, score, rank) with summary or, where the text is not needed, with its fusion key
fkey alone. Rows meet on the fusion key. Ties go by key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import scoring as X
from palimpsest.functions.text import fusion_key
from palimpsest.params import DEFAULT, Params

KEEP = ("pid", "summary", "importance", "ts", "entities")


def kept(channel: DataFrame) -> list[str]:
    return [c for c in KEEP if c in channel.columns]


def first_per_key(channel: DataFrame) -> DataFrame:
    """fkey with its best row: lowest rank, then pid."""
    held = (channel if "fkey" in channel.columns else channel.withColumn("fkey", fusion_key(F.col("summary")))).filter("fkey <> ''")
    one = W.partitionBy("query_id", "fkey").orderBy("rank", "pid")
    return held.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")


def arithmetic(vec: DataFrame, bm25: DataFrame, entities: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """query_id, fkey, KEEP, channels, fused, sort_key. Both channels: 1.8 times the geometric mean; one: 0.7 times; then importance and age.

    entities is accepted for the registry's sake and has no part in it.
    """
    v, b, keep = first_per_key(vec), first_per_key(bm25), kept(vec)
    both = v.select("query_id", "fkey", F.struct(*keep).alias("v"), F.col("score").alias("vs")).join(b.select("query_id", "fkey", F.struct(*keep).alias("b"), F.col("score").alias("bs")), ["query_id", "fkey"], "full_outer")
    both = both.filter(F.col("vs").isNotNull() | (F.col("bs") >= p.bm25_floor))
    dual = F.col("vs").isNotNull() & (F.col("bs") >= p.bm25_floor)
    orig = F.coalesce("vs", "bs")
    fused = F.when(dual, X.rounded(F.sqrt(F.col("vs") * F.col("bs")) * p.dual_boost)).otherwise(X.rounded(orig * p.single_penalty))
    channels = F.when(dual, "vec,bm25").when(F.col("vs").isNotNull(), "vec").otherwise("bm25")
    row = F.coalesce("v", "b")
    out = both.select("query_id", "fkey", *[row[c].alias(c) for c in keep], channels.alias("channels"), orig.alias("orig"), fused.alias("fused"))
    out = out.filter((F.col("channels") == "vec,bm25") | ((F.col("orig") > 0) & (F.col("fused") / F.col("orig") >= p.single_drop)))
    key = X.time_decay(X.importance_weight(F.col("fused"), F.col("importance"), p), F.col("ts"), p)
    return out.withColumn("sort_key", key).drop("orig")


def rrf(vec: DataFrame, bm25: DataFrame, entities: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """Reciprocal ranks of both channels, times 100; a summary that holds or shares one of the query's graph entities gains 15 %; then age.

    With entities the channels must have their summaries.
    """
    keep = kept(vec)
    ranked = [first_per_key(c).select("query_id", "fkey", F.struct("rank", F.struct(*keep).alias("r")).alias("best"), (1 / (p.rrf_k + F.col("rank"))).alias("part"), F.lit(i).alias("ch")) for i, c in enumerate((vec, bm25.filter(F.col("score") >= p.bm25_floor)))]
    both = ranked[0].unionByName(ranked[1])
    out = both.groupBy("query_id", "fkey").agg(F.sum("part").alias("s"), F.min_by(F.col("best.r"), F.col("ch")).alias("r"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("ch") == 0, "vec").otherwise("bm25"))), ",").alias("channels"))
    out = out.select("query_id", "fkey", *[F.col(f"r.{c}").alias(c) for c in keep], "channels", X.rounded(F.col("s") * 100, 6).alias("fused"))
    boosted = F.col("fused")
    if entities is not None:
        out = out.join(entities.select("query_id", F.col("names").alias("_names")), "query_id", "left")
        boosted = F.when(entity_hit(F.col("summary"), F.col("_names")) | F.coalesce(F.arrays_overlap("_names", "entities"), F.lit(False)), X.rounded(boosted * (1 + p.rrf_entity_boost), 6)).otherwise(boosted)
    out = out.withColumn("sort_key", X.time_decay(boosted, F.col("ts"), p))
    return out.drop("_names")


def entity_hit(summary: Column, names: Column) -> Column:
    """Whether any name occurs in the summary, whatever the case."""
    return F.coalesce(F.exists(names, lambda n: (n != "") & F.contains(F.lower(summary), F.lower(n))), F.lit(False))


def rrf_n(channels: dict[str, DataFrame], p: Params = DEFAULT) -> DataFrame:
    """query_id, summary, channels, score: reciprocal ranks of any number of channels by whole summary, with the top of each query at 1.

    Summaries meet by their digest, so that no long text is a shuffle key.
    """
    digest = F.md5(F.col("summary").cast("binary")).alias("_d")
    parts = [c.select("query_id", digest, "summary", "rank").groupBy("query_id", "_d").agg(F.min("rank").alias("rank"), F.any_value("summary").alias("summary")).select("query_id", "_d", "summary", F.lit(name).alias("channel"), (1 / (p.rrf_k + F.col("rank"))).alias("part")) for name, c in channels.items()]
    summed = reduce(DataFrame.unionByName, parts).groupBy("query_id", "_d").agg(F.sum("part").alias("s"), F.any_value("summary").alias("summary"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    return summed.select("query_id", "summary", "channels", X.rounded(F.col("s") / F.max("s").over(W.partitionBy("query_id"))).alias("score"))


def graph_boosted(fused: DataFrame, entities: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Items of the graph channel that name one of the query's entities gain the boost."""
    out = fused.join(entities.select("query_id", F.col("names").alias("_names")), "query_id", "left")
    hit = F.contains(F.col("channels"), F.lit("graph")) & entity_hit(F.col("summary"), F.col("_names"))
    return out.withColumn("sort_key", F.when(hit, X.rounded(F.col("sort_key") * (1 + p.graph_boost))).otherwise(F.col("sort_key"))).drop("_names")


def post_fuse(fused: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Relation points speak by their parent's summary; importance and age weigh."""
    if "parent_summary" in fused.columns:
        fused = fused.withColumn("summary", F.when(F.col("point_type") == "relation", F.coalesce("parent_summary", "summary")).otherwise(F.col("summary")))
    return fused.withColumn("sort_key", X.time_decay(X.importance_weight(F.col("sort_key"), F.col("importance"), p), F.col("ts"), p))


def top(fused: DataFrame, k: int, key: str = "sort_key", tie: str = "fkey") -> DataFrame:
    ranked = fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(key), tie)))
    return ranked.filter(F.col("rank") <= k)


def kg_verified(items: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Items (query_id, fkey, sort_key, sim) whose similarity holds up: blended score, weak flag, the best few."""
    kept = items.filter(F.col("sim") >= p.kg_weak).withColumns({"sort_key": X.kg_score(F.col("sort_key"), F.col("sim"), p), "is_weak": F.col("sim") < p.kg_strong})
    return top(kept, p.kg_top)


def keyword_filter(items: DataFrame, has_keyword: Column, min_keep: int, ratio: float) -> DataFrame:
    """The head stays; of the rest, those with a keyword come first, up to max(min_keep, share of all). A share of 0 keeps all."""
    if not ratio:
        return items
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "pid")
    held = items.withColumn("_n", F.row_number().over(by_score)).withColumn("_all", F.count("*").over(W.partitionBy("query_id")))
    later = W.partitionBy("query_id").orderBy(F.col("_n") > min_keep, F.when(F.col("_n") > min_keep, ~has_keyword).otherwise(F.lit(False)), "_n")
    most = F.greatest(F.lit(min_keep), F.floor(F.col("_all") * ratio).cast("int"))
    return held.withColumn("_m", F.row_number().over(later)).filter(F.col("_m") <= most).drop("_n", "_m", "_all")


Fusion = Callable[[DataFrame, DataFrame, DataFrame | None, Params], DataFrame]
_registry: dict[str, Fusion] = {"arithmetic": arithmetic, "rrf": rrf}
_current = ["arithmetic"]


def register(name: str, fusion: Fusion) -> None:
    _registry[name] = fusion


def algorithms() -> list[str]:
    return sorted(_registry)


def current() -> str:
    return _current[0]


def switch(name: str) -> str:
    if name not in _registry:
        raise ValueError(f"unknown fusion {name!r}; known: {', '.join(algorithms())}")
    _current[0] = name
    return name


def reset(env: dict[str, str] | None = None) -> str:
    return switch((env or {}).get("PALIMPSEST_FUSION", "arithmetic"))


def fuse(vec: DataFrame, bm25: DataFrame, entities: DataFrame | None = None, p: Params = DEFAULT, name: str | None = None) -> DataFrame:
    return _registry[name or current()](vec, bm25, entities, p)
