"""Dense search: many queries against all records at once.

Queries travel in blocks of a bounded number of vectors; each block is one broadcast and one pass in which every Arrow batch keeps its k best
records for each query and group, so that the shuffle carries candidates only. A window then keeps the k best of all. Similarities are
rounded to 4 places before they rank; ties go by pid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.scoring import rounded

BLOCK = 4096


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    return m


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    ids, vectors = [], []
    for r in queries.select("query_id", "embedding").filter("embedding is not null").toLocalIterator():
        ids.append(r.query_id)
        vectors.append(r.embedding)
        if len(ids) == BLOCK:
            yield ids, np.array(vectors, float)
            ids, vectors = [], []
    if ids:
        yield ids, np.array(vectors, float)


def dense_top_k(queries: DataFrame, memories: DataFrame, k: int, floor: float, per: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """query_id, pid, sim, rank (and `per`, keep): the k most similar records of each query (and group) at the floor or above.

    Records without a vector, or with one of another dimension than the queries', are left out. keep: further columns of memories to return.
    """
    held = memories.filter("embedding is not null").select("pid", F.coalesce(F.col(per).cast("string"), F.lit("")).alias("grp") if per else F.lit("").alias("grp"), "embedding")
    kind = queries.schema["query_id"].dataType.simpleString()
    types = {"int": pa.int32(), "bigint": pa.int64()}
    found = None
    for ids, q in _blocks(queries):
        shared = queries.sparkSession.sparkContext.broadcast((np.array(ids), q, np.linalg.norm(q, axis=1)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, vectors, norms = shared.value
            for b in batches:
                wide = pc.fill_null(pc.equal(pc.list_value_length(b.column(2)), vectors.shape[1]), False)
                b = b.filter(wide)
                if not b.num_rows:
                    continue
                m = _matrix(b.column(2))
                sim = m @ vectors.T / (np.linalg.norm(m, axis=1)[:, None] * norms + 1e-9)
                grp = np.array(b.column(1).to_pylist())
                rows, cols = [], []
                for g in np.unique(grp):
                    at = np.flatnonzero(grp == g)
                    # All that reach the k-th best of the batch stay, so that ties after rounding are settled over all batches.
                    part = sim[at]
                    edge = np.partition(part, len(at) - k, axis=0)[len(at) - k] - 2e-4 if len(at) > k else np.full(part.shape[1], -2.0)
                    r, c = np.nonzero(part >= np.maximum(edge, floor - 1e-4))
                    rows.append(at[r])
                    cols.append(c)
                r, c = np.concatenate(rows), np.concatenate(cols)
                yield pa.RecordBatch.from_arrays([pa.array(names[c], types.get(kind, pa.string())), b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r)), pa.array(sim[r, c])], names=["query_id", "pid", "grp", "sim"])

        part = held.mapInArrow(run, f"query_id {kind}, pid string, grp string, sim double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], f"query_id {kind}, pid string, grp string, sim double")
    found = found.withColumn("sim", rounded(F.col("sim"))).filter(F.col("sim") >= floor)
    rank = W.partitionBy("query_id", "grp").orderBy(F.desc("sim"), "pid")
    out = found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    out = out.withColumnRenamed("grp", per) if per else out.drop("grp")
    extra = [c for c in keep if c != per]
    return out.join(memories.select("pid", *extra), "pid") if extra else out


def similar_pairs(vectors: DataFrame, floor: float, block: int = 1024) -> DataFrame:
    """a < b, sim: all pairs at the floor or above, exactly, in blocks against blocks. Rows: pid, embedding (one dimension).

    Each unordered pair of blocks is one bounded group of at most 2 * block vectors; the exact form is quadratic in compute by nature, so for
    large tables narrow the input first (lsh_pairs).
    """
    n = max(1, -(-vectors.count() // block))
    held = vectors.filter("embedding is not null").withColumn("blk", F.pmod(F.xxhash64("pid"), F.lit(n)).cast("int"))
    cell = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cell = cell.select(F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "pid", "embedding")

    def run(t: pa.Table) -> pa.Table:
        i, j, blk = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("blk").to_numpy()
        pid = np.array(t.column("pid").to_pylist(), object)
        m = _matrix(t.column("embedding").combine_chunks())
        norm = np.linalg.norm(m, axis=1)
        x, y = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        sim = m[x] @ m[y].T / (norm[x][:, None] * norm[y] + 1e-9)
        r, c = np.nonzero(sim >= floor - 1e-4)
        a, b, s = pid[x[r]], pid[y[c]], sim[r, c]
        keep = a < b if i == j else np.ones(len(a), bool)
        a, b, s = a[keep], b[keep], s[keep]
        lo, hi = np.where(a < b, a, b), np.where(a < b, b, a)
        return pa.table({"a": pa.array(lo, pa.string()), "b": pa.array(hi, pa.string()), "sim": pa.array(s, pa.float64())})

    out = cell.groupBy("i", "j").applyInArrow(run, "a string, b string, sim double")
    return out.withColumn("sim", rounded(F.col("sim"))).filter(F.col("sim") >= floor)


def lsh_pairs(vectors: DataFrame, floor: float, tables: int = 8, width: float = 0.5) -> DataFrame:
    """Approximate pairs by random projections (on unit vectors the squared distance is 2 - 2 * cosine)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    held = vectors.filter("embedding is not null").select("pid", array_to_vector(F.col("embedding").cast("array<double>")).alias("_v"))
    unit = Normalizer(inputCol="_v", outputCol="v", p=2.0).transform(held).select("pid", "v")
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", numHashTables=tables, bucketLength=width, seed=1).fit(unit)
    far = (2 - 2 * floor) ** 0.5
    both = model.approxSimilarityJoin(unit, unit, far, "d").filter("datasetA.pid < datasetB.pid")
    return both.select(F.col("datasetA.pid").alias("a"), F.col("datasetB.pid").alias("b"), rounded(1 - F.col("d") ** 2 / 2).alias("sim"))


Embedder = Callable[[list[str]], list[list[float]]]


def embed(df: DataFrame, column: str, model: Embedder, out: str = "embedding") -> DataFrame:
    """Adds vectors by an injected model, in Arrow batches; a failing batch gives empty vectors."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def run(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        try:
            return pd.Series(model(texts.fillna("").tolist()))
        except Exception:  # noqa: BLE001  the model is foreign code
            return pd.Series([[] for _ in texts])

    return df.withColumn(out, run(F.col(column)))


def hashing_embedder(dim: int = 64) -> Embedder:
    """A deterministic stand-in: signed word hashes, normalised."""

    def run(texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 16 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).astype(float).tolist()

    return run
