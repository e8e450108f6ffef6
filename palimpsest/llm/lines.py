"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches of ascending doc_id. Each batch's line keys merge-anti-join the runs (bucketed by hash and sorted, so no run is
shuffled again); keys that no run holds become a new run with the smallest doc_id that holds them. When a level has `fanout` runs they are
merged into one run of the next level. A key's first document is final once it is in a run, because later batches have larger doc_ids.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased; keys of fewer than `least` characters are never dropped.
Keys are compared by 96 bits of xxh3.

Null texts count as one empty line. Documents are doc_ids: rows that share a doc_id are one document, and each keeps the lines of keys whose
smallest doc_id it is. A null doc_id is larger than all others. Texts of any length are read whole. An empty table gives an empty result. Only doc_id
and text matter; `dedup_lines` passes extra columns through and replaces columns named like its outputs.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, col_or_null, partitions, raw, schema_with, slices, spare_name, with_columns

SPACE, LAST = b" \t\n\x0b\x0c\r", (1 << 63) - 1
KEYS = "batch int, h1 long, h2 long, chunk int, lo long, hi long"


def line_key(line: bytes, least: int = 10) -> bytes | None:
    key = line.strip(SPACE).lower()
    return key if len(key) >= least and (key.isascii() or len(key.decode()) >= least) else None


def key_hash(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(key)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:12], "little")


def chunk_of(doc_id: int, chunks: int) -> int:
    return xxhash.xxh32_intdigest(b"%d" % doc_id) % chunks


def line_keys(docs: DataFrame, bounds: list[int], chunks: int, least: int) -> DataFrame:
    """One row for each key, batch and chunk of documents: the smallest and largest doc_id. A key held by every document has `chunks` rows a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            seen: dict[tuple[int, int, int, int], list[int]] = {}
            for d, text in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                d = LAST if d is None else d
                batch, chunk = bisect_left(bounds, d), chunk_of(d, chunks)
                for key in {k for line in (text or b"").split(b"\n") if (k := line_key(line, least)) is not None}:
                    at = (batch, *key_hash(key), chunk)
                    if old := seen.get(at):
                        old[0], old[1] = min(old[0], d), max(old[1], d)
                    else:
                        seen[at] = [d, d]
            columns = list(zip(*seen, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())],
                names=["batch", "h1", "h2", "chunk", "lo", "hi"],
            )

    found = docs.mapInArrow(run, KEYS)
    return found.groupBy("batch", "h1", "h2", "chunk").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


class LineIndex:
    """Levelled runs (h1, h2, first) as bucketed tables in the warehouse."""

    def __init__(self, ws: Workspace, buckets: int, fanout: int = 3):
        self.ws, self.spark, self.buckets, self.fanout = ws, ws.spark, buckets, fanout
        self.name, self.n = f"palimpsest_lines_{uuid.uuid4().hex}", 0
        self.levels: list[list[str]] = []

    def table(self, df: DataFrame, partition: str | None = None) -> str:
        """Written so that each task holds whole buckets: one sorted file for each."""
        name = self.ws.table(f"{self.name}_{self.n}")
        self.n += 1
        writer = df.repartition(self.buckets, "h1", "h2").write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        (writer.partitionBy(partition) if partition else writer).saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """keys with `first`: the smallest doc_id in any run, null for keys that no run holds."""
        for i, name in enumerate(self.runs()):
            run = self.spark.table(name).select("h1", "h2", F.col("first").alias(f"_r{i}"))
            keys = keys.join(run.hint("merge"), ["h1", "h2"], "left")
        found = [F.col(f"_r{i}") for i in range(len(self.runs()))]
        return keys.withColumn("first", F.coalesce(*found, F.lit(None).cast("long"))).drop(*[f"_r{i}" for i in range(len(found))])

    def add(self, new: DataFrame) -> None:
        """A run of keys that no run holds; levels that are full are merged upwards."""
        self._push(0, self.table(new.select("h1", "h2", "first")))

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for other in full[1:]:
                merged = merged.unionByName(self.spark.table(other))
            self._push(level + 1, self.table(merged))
            for old in full:
                self.ws.drop_table(old)

    def drop(self) -> None:
        for name in self.runs():
            self.ws.drop_table(name)
        self.levels = []


def decisions(ws: Workspace, docs: DataFrame, batches: int, chunks: int, least: int) -> list[DataFrame]:
    """chunk, h1, h2, first: keys that a chunk's documents other than `first` must drop, one staged table for each batch."""
    spark = docs.sparkSession
    index = LineIndex(ws, partitions(spark))
    ids = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"))
    bounds = sorted(set(ids.agg(F.percentile_approx("d", [i / batches for i in range(1, batches)], 10_000).alias("q")).first().q or [])) if batches > 1 else []
    keys = index.table(line_keys(docs, bounds, chunks, least), "batch")
    out = []
    for k in range(len(bounds) + 1):
        batch = index.lookup(spark.table(keys).filter(F.col("batch") == k))
        batch = batch.withColumn("own", F.min("lo").over(W.partitionBy("h1", "h2")))
        judged = batch.select("h1", "h2", "chunk", "lo", "hi", "own", "first")
        out.append(ws.stage(judged.filter(F.col("hi") > F.coalesce("first", "own")).select("chunk", "h1", "h2", F.coalesce("first", "own").alias("first")), f"drop{k}"))
        if k < len(bounds):
            index.add(judged.filter("first is null and lo = own").select("h1", "h2", F.col("own").alias("first")).dropDuplicates(["h1", "h2"]))
    index.drop()
    ws.drop_table(keys)
    return out


def dedup_lines(docs: DataFrame, batches: int = 6, least: int = 10, keep_text: bool = True) -> DataFrame:
    """docs with text deduplicated (unless keep_text is False: then text goes), n_lines, n_dropped and kept_sha256.

    Decisions and documents meet by chunk: each task sorts a chunk's decisions before its documents and holds one chunk's decisions.
    """
    spark = docs.sparkSession
    chunks = 8 * partitions(spark)
    core = docs.select(col_or_null(docs, "doc_id", "long").alias("doc_id"), col_or_null(docs, "text", "string").alias("text"))
    ws = Workspace(spark)
    found = decisions(ws, core, batches, chunks, least)
    drops = reduce(DataFrame.unionByName, found)

    rest = docs if keep_text else core
    rest = rest.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    columns = list(rest.columns)
    chunk_, kind_, h1_, h2_, first_ = (spare_name(rest, n) for n in ("_chunk", "_kind", "_h1", "_h2", "_first"))

    def placed(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            ids = b.column(b.schema.names.index("doc_id")).to_pylist()
            yield with_columns(b, {chunk_: pa.array([chunk_of(LAST if d is None else d, chunks) for d in ids], pa.int32())})

    rows = rest.mapInArrow(placed, schema_with(rest, **{chunk_: "int"})).withColumns({kind_: F.lit(1), h1_: F.lit(None).cast("long"), h2_: F.lit(None).cast("long"), first_: F.lit(None).cast("long")})
    told = drops.select(F.col("chunk").alias(chunk_), F.lit(0).alias(kind_), F.col("h1").alias(h1_), F.col("h2").alias(h2_), F.col("first").alias(first_))
    both = rows.unionByName(told, allowMissingColumns=True).repartition(partitions(spark), chunk_).sortWithinPartitions(chunk_, kind_)
    keep = [c for c in columns if keep_text or c != "text"]
    keep = [c for c in keep if c not in ("n_lines", "n_dropped", "kept_sha256")]

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, first = None, {}
        for b in slices(batches_, 2048):
            at = {n: i for i, n in enumerate(b.schema.names)}
            kinds, of = b.column(at[kind_]).to_pylist(), b.column(at[chunk_]).to_pylist()
            h1, h2, f = (b.column(at[c]).to_pylist() for c in (h1_, h2_, first_))
            ids, texts = b.column(at["doc_id"]).to_pylist(), raw(b.column(at["text"]))
            kept, lines, dropped, digest = [], [], [], []
            for i, kind in enumerate(kinds):
                if of[i] != chunk:
                    chunk, first = of[i], {}
                if kind == 0:
                    first[h1[i], h2[i]] = f[i]
                    continue
                d = LAST if ids[i] is None else ids[i]
                every = (texts[i] or b"").split(b"\n")
                left = [x for x in every if not first or (k := line_key(x, least)) is None or first.get(key_hash(k), d) == d]
                out = b"\n".join(left)
                kept.append(out if texts[i] is not None else None)
                lines.append(len(every))
                dropped.append(len(every) - len(left))
                digest.append(hashlib.sha256(out).hexdigest())
            docs_only = b.filter(pa.array([k == 1 for k in kinds], pa.bool_())).select(keep)
            new = {"n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            yield with_columns(docs_only, ({"text": pa.array([t.decode() if t is not None else None for t in kept], pa.string())} if keep_text else {}) | new)

    out = both.mapInArrow(run, schema_with(rest.select(*[f"`{c}`" for c in keep]), n_lines="long", n_dropped="long", kept_sha256="string"))
    if not keep_text:
        out = ws.stage(out, "digests")
        ws.drop(*found)
    return out


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept and dropped of every document."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
