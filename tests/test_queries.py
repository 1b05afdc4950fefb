"""Every query of the engine runs on the smallest tables, and agrees with its SQL where DuckDB is there."""

import decimal
import os

import pytest

from trajecta.plans import queries as catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def normal(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, tables, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    if sql := catalogue.oracle_sql().get(name):
        said = tables.execute(sql)
        names = [x[0] for x in said.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(normal(dict(zip(names, r))[c]) for c in columns) for r in said.fetchall())
