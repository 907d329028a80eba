"""Every query that has SQL gives the same rows by DuckDB; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()
QUERIES = entry.queries()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


def table_rows(table, names):
    return sorted(zip(*[[plain(v) for v in table.column(n).to_pylist()] for n in sorted(names)]), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{data}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = df.toArrow()
    if name in SQL:
        want = duck.sql(SQL[name]).to_arrow_table()
        assert sorted(df.columns) == sorted(want.column_names)
        assert table_rows(got, df.columns) == table_rows(want, want.column_names)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
