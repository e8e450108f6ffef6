"""The shared work folder and the tables that operators write there."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: Workspaces that still own files or tables, by application; for whom new ones are opened.
_open: dict[str, list[Workspace]] = {}
_owner = ""


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local master takes a temporary folder; a cluster must name a shared one."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


#: Arrow batches unless the session has set its own: so many rows and bytes at most, so that batches of long texts stay small on both sides of the pipe.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2048"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(16 << 20))}


def small_batches(spark: SparkSession) -> None:
    for key, (default, wanted) in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or now == default or (default is None and int(now) > 1 << 30):
            spark.conf.set(key, wanted)


class Workspace:
    """Tables that one operator run writes to the shared folder. Written tables cut lineage: a lost executor costs a re-read, not a recomputation.

    An operator drops what it no longer reads. What its lazy result still reads stays until `release`, which the caller runs once the
    result is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n, self.freed = spark, shared_dir(spark), 0, time.monotonic()
        self.tables: set[str] = set()
        small_batches(spark)
        self.owner = _owner
        _open.setdefault(spark.sparkContext.applicationId, []).append(self)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def stage(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", compression).parquet(path)
        schema = df.schema
        del df
        self.free()
        out = self.spark.read.schema(schema).parquet(path)
        out._staged_at = path
        return out

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """df as a catalogue table dealt by a hash of the key, one file a bucket: later joins on the key shuffle the other side only."""
        name, n = self.table(f"palimpsest_{uuid.uuid4().hex}"), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, key).write.format("parquet").option("compression", "zstd").bucketBy(n, key).saveAsTable(name)
        self.free()
        out = self.spark.table(name)
        out._staged_as = name
        return out

    def free(self) -> None:
        """Lets Spark delete shuffle files that no live plan needs: it does so when the driver collects garbage, which an idle driver hardly does."""
        if time.monotonic() - self.freed > 3:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            self.freed = time.monotonic()

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *staged: DataFrame | None) -> None:
        """Deletes staged tables (as `stage` and `bucketed` returned them)."""
        for df in staged:
            if df is not None and "_staged_as" in df.__dict__:
                self.drop_table(df._staged_as)
            elif df is not None:
                self._delete(df._staged_at)

    def table(self, name: str) -> str:
        """Notes a catalogue table that goes with this workspace."""
        self.tables.add(name)
        return name

    def drop_table(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.discard(name)

    def close(self) -> None:
        """Deletes all that this workspace still owns."""
        for name in [*self.tables]:
            self.drop_table(name)
        self._delete(self.root)
        mine = _open.get(self.spark.sparkContext.applicationId, [])
        if self in mine:
            mine.remove(self)


def release(spark: SparkSession, owner: str | None = None) -> None:
    """Deletes the working tables of an owner's operators, or of all that ran so far in this application. Their lazy results must have been written."""
    for ws in [*_open.get(spark.sparkContext.applicationId, [])]:
        if owner in (None, ws.owner):
            ws.close()


@contextmanager
def stage_tables(spark: SparkSession, owner: str = "stage") -> Iterator[None]:
    """Operators called inside work for one pipeline stage. What the stage before left is deleted first: its result has been written by then."""
    global _owner
    release(spark, owner)
    before, _owner = _owner, owner
    try:
        yield
    finally:
        _owner = before
