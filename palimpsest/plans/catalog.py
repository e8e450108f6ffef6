"""The registry of queries: each a callable (spark, sf_dir) with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def widened(df: DataFrame) -> DataFrame:
    """Integers as longs, floats as doubles, so that results have one type each in every engine."""
    wide = {"int": "long", "smallint": "long", "tinyint": "long", "float": "double"}
    return df.select(*[F.col(f"`{c}`").cast(wide[t]).alias(c) if t in wide else F.col(f"`{c}`") for c, t in df.dtypes])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: widened(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from palimpsest.plans import audit_queries, event_queries, graph_queries, layer_queries, recall_queries, search_queries, text_queries, write_queries  # noqa: F401

    return QUERIES, SQL
