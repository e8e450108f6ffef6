"""The star-schema tables seen as memories, graph, recall queries and hook events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One L1 record a document, with its vector, label and event time where there are any."""
    d, v, l, e = (table(spark, sf_dir, n) for n in ("documents", "embeddings", "labels", "events"))
    d = d.join(v.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").join(l.select("doc_id", "quality"), "doc_id", "left")
    d = d.join(e.select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts")), "doc_id", "left")
    return d.select(
        F.col("doc_id").cast("string").alias("pid"),
        F.lit("L1").alias("layer"),
        F.col("source").alias("collection"),
        F.col("lang").alias("memory_type"),
        F.col("text").alias("summary"),
        F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("importance"),
        F.array("lang", "source").alias("entities"),
        F.array("lang").alias("tags"),
        "ts",
        "embedding",
    )


def recall_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries, with the vector of the same number."""
    b, v = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return b.join(v.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id").select(F.col("item_id").alias("query_id"), "text", "embedding")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("customer", "c_name", "Person"), ("nation", "n_name", "Place"), ("region", "r_name", "Place"), ("part", "p_name", "Product")]
    out = None
    for name, col, label in parts:
        one = table(spark, sf_dir, name).select(F.col(col).alias("name"), F.lit(label).alias("label")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOCATED_IN, PART_OF and ORDERED edges; duplicates, null states and empty summaries occur."""
    c, n, r, p, o, li = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "part", "orders", "lineitem"))
    none = F.lit(None).cast("timestamp")
    located = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("c"), "c_custkey").alias("eid"), F.col("c_name").alias("subj"), F.lit("LOCATED_IN").alias("pred"), F.col("n_name").alias("obj"), F.lit(None).cast("string").alias("status"), F.lit("crm").alias("source"), none.alias("updated"), F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("string").alias("ko_summary")
    )
    part_of = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("n"), "n_nationkey").alias("eid"), F.col("n_name").alias("subj"), F.lit("PART_OF").alias("pred"), F.col("r_name").alias("obj"), F.lit("active").alias("status"), F.lit("geo").alias("source"), none.alias("updated"), F.lit(None).cast("string").alias("superseded_by"), F.lit("geography").alias("ko_summary")
    )
    lines = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(p, li.l_partkey == p.p_partkey)
    ordered = lines.select(
        F.concat(F.lit("o"), "l_orderkey", F.lit("-"), "l_linenumber").alias("eid"),
        F.col("c_name").alias("subj"),
        F.lit("ORDERED").alias("pred"),
        F.col("p_name").alias("obj"),
        F.when(F.col("l_linestatus") == "O", "active").otherwise("superseded").alias("status"),
        F.col("o_orderpriority").alias("source"),
        F.col("l_shipdate").cast("timestamp").alias("updated"),
        F.when((F.col("l_linestatus") != "O") & (F.col("l_returnflag") == "R"), F.col("p_name")).alias("superseded_by"),
        F.when(F.col("l_returnflag") != "N", F.concat_ws(" ", "c_name", F.lit("ORDERED"), "p_name")).alias("ko_summary"),
    )
    return located.unionByName(part_of).unionByName(ordered)


def hook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"), F.col("user_id").alias("session_key"), F.get_json_object("props", "$.k").alias("k"), "value")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every conversation turn as a message."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line", "message"))
