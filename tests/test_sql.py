"""Registered queries against their SQL on the smallest given tables: some of each kind (the whole set takes long)."""

from __future__ import annotations

import math
import os

import pytest

from palimpsest.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.load()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["recall_with_graph", "write_layers", "orphan_edges_all", "association_recall", "delete_by_query", "graph_trails"])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(SQL[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    got = sorted((plain(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    assert got == sorted((plain(tuple(r[i] for i in at)) for r in expected.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
