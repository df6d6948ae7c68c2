"""Every registered query against its DuckDB twin (the driver's check, at sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as entry
from recallscope.plans import catalog
from tests.conftest import SF001
from tools.oracle_check import SPARK_TYPE, TABLES, rows_of

QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["vendor", "model", "condition"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF001)
    s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(SQL[name])
    d_cols = [d[0] for d in cur.description]
    d_rows = rows_of(d_cols, cur.fetchall())
    assert sorted(df.columns) == sorted(d_cols)
    assert s_rows == d_rows
    rel = con.sql(SQL[name])
    d_types = {c: SPARK_TYPE.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    assert dict(df.dtypes) == d_types
