"""Every registered query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from foldspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "smallint": "SMALLINT"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return repr(float(v)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    want = sql.sql(catalog.ORACLE[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry_runs(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
