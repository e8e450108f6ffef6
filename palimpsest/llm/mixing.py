"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a seeded shuffled order and repeat in epochs. A document's virtual finish time is the cumulative tokens of
its source up to and with it, divided by the source's target. All sources' queue entries are range-sorted by finish time over the whole
cluster and truncated where the total budget is spent; whole documents are taken.

Null texts have size 0 and are never taken; a null source is a source, last in order. Texts of any length count whole. Documents with equal doc_id are
separate rows; equal rows share a place in the order, so which of two equal rows is cut never shows in the result. Empty tables give empty
results. Extra columns, whatever their names, pass through `mix`; `plan` returns its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, col_or_null, partitions, raw, slices, spare_name

WEIGHTS = (5.0, 2.0, 1.0)


def sizes(docs: DataFrame, seed: int = 0, rid: str | None = None) -> DataFrame:
    """_rid, doc_id, _source (a key that tells null from any string), size in words, _order (the seeded shuffle's 64-bit key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, ids = raw(b.column(3)), b.column(1).to_pylist()
            order = [xxhash.xxh64_intdigest(b"%r|" % i + (t or b""), seed) - (1 << 63) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len((t or b"").split()) for t in texts], pa.int64()), pa.array(order, pa.int64())], names=["_rid", "doc_id", "_source", "size", "_order"])

    source = col_or_null(docs, "source", "string")
    key = F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))
    return docs.select((F.col(f"`{rid}`") if rid else F.monotonically_increasing_id()).alias("_rid"), col_or_null(docs, "doc_id", "long").alias("doc_id"), key.alias("_source"), col_or_null(docs, "text", "string").alias("t")).mapInArrow(
        run, "_rid long, doc_id long, _source string, size long, _order long"
    )


def targets(ws: Workspace, sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (_source, source_size) with target, by weight; what is above `most` times a source's size is reshared until none is above.

    Targets are the level of water-filling: a source has unit * weight, or its limit if that is less. The driver holds the unit and one count for each
    sort partition, however many sources there are.
    """
    spark = sources.sparkSession
    ranged = sources.repartitionByRange(partitions(spark), F.col("_source") == "-", "_source").sortWithinPartitions(F.col("_source") == "-", "_source")
    ranged = ws.stage(ranged.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "sources")
    first, base = 0, []
    for r in sorted(ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()):
        base.append((r._p, first))
        first += r.n
    if not base:
        return ranged.select("_source", "source_size", F.lit(0.0).alias("target"))
    place = F.col("_i") + F.element_at(F.create_map(*[F.lit(x) for pair in base for x in pair]), F.col("_p"))
    weighed = ranged.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    limit, total = F.col("source_size") * most, weighed.agg(F.sum("source_size"), F.sum("_w")).first()
    unit, full = share * total[0] / total[1], -1
    while True:
        over = F.col("_w") * unit >= limit
        n, spent, free = weighed.agg(F.count_if(over), F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_w")))).first()
        if n == full or not free:
            return weighed.select("_source", "source_size", F.when(over, limit).otherwise(F.col("_w") * unit).alias("target"))
        unit, full = (share * total[0] - spent) / free, n


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0, rid: str | None = None) -> DataFrame:
    """_rid, doc_id, size, source_size, target, copies (epochs in which the document is taken), taken. rid: a column that numbers the rows, if docs has one.

    The driver holds one number for each sort partition.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    rows = ws.stage(sizes(docs, seed, rid), "sizes")
    per_source = rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
    goal = ws.stage(targets(ws, per_source, weights, share, most), "targets")
    n_rows, words = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    sized = rows
    rows = rows.join(goal, "_source")

    # Cumulative tokens: blocks of the shuffled order, then positions within a block, so that no source is one task.
    bits = max(1, (n_rows // 4096).bit_length())
    placed = rows.withColumn("_block", F.shiftrightunsigned(F.col("_order"), 64 - bits))
    before = W.partitionBy("_source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = placed.groupBy("_source", "_block").agg(F.sum("size").alias("s")).select("_source", "_block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy("_source", "_block").orderBy("_order", "doc_id", "size", "_rid").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("_cum", F.sum("size").over(within)).join(blocks, ["_source", "_block"])
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max(0, -int(-most // 1) - 1)))).alias("_epoch")
    queue = placed.filter("size > 0 and target > 0").select("_rid", "_source", "_order", "size", "target", "source_size", F.col("_before"), "_cum", epochs)
    queue = queue.withColumn("_finish", (F.col("_before") + F.col("_cum") + F.col("_epoch") * F.col("source_size")) / F.col("target"))
    # A source's last epoch may reach beyond what any document may give.
    queue = queue.filter(F.col("_epoch") * F.col("source_size") < F.col("target")).select("_rid", "_source", "_order", "_finish", "size", "_epoch")

    staged = ws.stage(queue, "queue")
    keys = ["_finish", "_source", "_order", "_rid"]
    ranged = ws.stage(staged.repartitionByRange(partitions(spark), *keys).withColumn("_part", F.spark_partition_id()), "ranged")
    budget, spent, cut = share * words, 0, None
    for r in sorted(ranged.groupBy("_part").agg(F.sum("size").alias("s")).collect()):
        if spent + r.s > budget:
            cut = r._part
            break
        spent += r.s
    if cut is None:
        taken = ranged
    else:
        last = ranged.filter(F.col("_part") == cut).withColumn("_sum", F.sum("size").over(W.partitionBy("_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)))
        taken = ranged.filter(F.col("_part") < cut).unionByName(last.filter(F.col("_sum") + spent <= budget).drop("_sum"))
    copies = taken.groupBy("_rid").agg(F.count("*").alias("copies"))
    out = rows.join(copies, "_rid", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    out = ws.stage(out.select("_rid", "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")), "plan")
    ws.drop(staged, ranged, sized, goal)
    return out


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every taken document as often as it is taken, with the columns of docs. The documents are written once, bucketed by row, so that texts are shuffled once however many there are."""
    rid = spare_name(docs, "_rid")
    kept = Workspace(docs.sparkSession).bucketed(docs.withColumn(rid, F.monotonically_increasing_id()), rid)
    times = spare_name(kept, "_times")
    chosen = plan(kept, rid=rid, **options).filter("copies > 0").select(F.col("_rid").alias(rid), F.col("copies").cast("int").alias(times))
    out = kept.join(chosen, rid)
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(f"`{times}`")))).select(*[f"`{c}`" for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
