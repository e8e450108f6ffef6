"""Okapi BM25 as DataFrames: postings, corpus statistics, and search for many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import Segmenter, tokens
from palimpsest.functions.scoring import rounded
from palimpsest.params import DEFAULT, Params
from palimpsest.storage import Workspace


@dataclass(frozen=True)
class Index:
    """docs(pid, dl, t: tokens), terms(term, df), corpus(n, avgdl). Written tables make it the persisted index."""

    docs: DataFrame
    terms: DataFrame
    corpus: DataFrame

    @classmethod
    def of(cls, docs: DataFrame) -> Index:
        """The index of tokenised documents. Frequencies are partial-aggregated before any shuffle."""
        terms = docs.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        return cls(docs, terms, docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))

    def write(self, path: str) -> None:
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        for name in ("terms", "corpus"):
            getattr(Index.of(self.docs.sparkSession.read.parquet(f"{path}/docs")), name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("docs", "terms", "corpus")))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores where they come from fewer files than there are cores; larger inputs stay as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n else df


def build(memories: DataFrame, column: str = "summary", cjk: bool = True, stop: list[str] | None = None, segment: Segmenter | None = None, keep: tuple[str, ...] = ()) -> Index:
    """A search must cut text as its index does (cjk, stop, segment). Documents without tokens count in N and in the mean length.

    The tokens are written to the shared work folder, so that the texts are read and cut once however often the index is used. keep: further columns
    of memories to hold beside them.
    """
    docs = spread(memories.select("pid", *keep, column))
    docs = docs.select("pid", *keep, tokens(F.coalesce(F.col(column), F.lit("")), stop, cjk, segment).alias("t")).withColumn("dl", F.size("t"))
    return Index.of(Workspace(memories.sparkSession).stage(docs, "tokens", "lz4"))


def idf(index: Index, p: Params = DEFAULT) -> DataFrame:
    """term, idf: negative values become a share of the mean of all terms' idf."""
    n, df = F.col("n"), F.col("df")
    raw = F.log(n - df + 0.5) - F.log(df + 0.5)
    all_terms = index.terms.crossJoin(F.broadcast(index.corpus.select("n"))).withColumn("idf0", raw)  # corpus has one row
    mean = all_terms.agg(F.avg("idf0").alias("mean"))
    return all_terms.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("idf0") < 0, p.bm25_idf_floor * F.col("mean")).otherwise(F.col("idf0")).alias("idf"))


def search(queries: DataFrame, index: Index, k: int | None = None, p: Params = DEFAULT, floor: float | None = None, cjk: bool = True, stop: list[str] | None = None, segment: Segmenter | None = None) -> DataFrame:
    """query_id, pid, raw, norm_score, rank. A term repeated in a query counts each time. Scores of 0 and below go.

    Only the queries' terms leave the documents' token lists, where each is counted before any shuffle; Spark broadcasts the asked terms where they are
    small, so that no term's postings meet in one task, and splits the join of a frequent term where they are not.
    """
    k = p.bm25_top_k if k is None else k
    asked = queries.select("query_id", F.explode(tokens(F.coalesce(F.col("text"), F.lit("")), stop, cjk, segment)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    words = asked.select("term").distinct().join(idf(index, p), "term")
    postings = index.docs.select("pid", "dl", F.explode("t").alias("term")).join(words, "term").groupBy("term", "pid", "dl", "idf").agg(F.count("*").alias("tf"))
    hits = postings.join(asked, "term").crossJoin(F.broadcast(index.corpus.select("avgdl")))
    tf = F.col("tf")
    part = F.col("qn") * F.col("idf") * tf * (p.bm25_k1 + 1) / (tf + p.bm25_k1 * (1 - p.bm25_b + p.bm25_b * F.col("dl") / F.col("avgdl")))
    scores = hits.groupBy("query_id", "pid").agg(rounded(F.sum(part)).alias("raw")).filter("raw > 0")
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("raw"), "pid"))).filter(F.col("rank") <= k)
    out = ranked.withColumn("norm_score", rounded(F.col("raw") / F.max("raw").over(W.partitionBy("query_id"))))
    return out if floor is None else out.filter(F.col("norm_score") >= floor)


def corpus_hash(memories: DataFrame) -> DataFrame:
    """An order-free fingerprint of all summaries: it changes whenever any summary does. Partial sums only, no row is gathered."""
    h = F.xxhash64(F.coalesce("summary", F.lit("")))
    return memories.agg(F.count("*").alias("n"), F.sum(F.shiftright(h, 32)).alias("high"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("low"))
