"""Every query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__
from strandlake.plans import files, queries, rules  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def _plain(v):
    return float(f"{v:.10g}") if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):
    df = queries.QUERIES[name](spark, SF)
    want = tables.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(repr([_plain(v) for v in r]) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_contract(spark):
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and set(queries.QUERIES) <= set(found)
    assert __spark_entry__.entry(spark).count() >= 0
