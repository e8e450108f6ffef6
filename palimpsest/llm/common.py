"""Helpers shared by the training-data operators: names, Arrow access to text, hashes. The work folder and its tables are the library's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.storage import Workspace, release, shared_dir, small_batches, stage_tables

__all__ = ["Workspace", "release", "shared_dir", "small_batches", "stage_tables"]


def spare_name(df: DataFrame, name: str) -> str:
    """The name, with underscores after it until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None where null."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def col_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or a typed null where the table lacks it."""
    return (F.col(f"`{name}`") if has(df, name) else F.lit(None)).cast(kind)


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns replaced or appended."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for k, v in new.items():
        if k in names:
            arrays[names.index(k)] = v
        else:
            names.append(k)
            arrays.append(v)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that Python objects for one batch of long texts stay few."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def schema_with(df: DataFrame, **added: str) -> str:
    """DDL of df's columns with some replaced or appended."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields} | added
    return ", ".join(f"`{k}` {v}" for k, v in kinds.items())


def mapped(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), for hashes of hashes."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal values in the first `keys` columns, over batch borders; for input sorted by them."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for a, z in zip(starts, [*starts[1:], b.num_rows], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)
