"""Every query with SQL gives DuckDB's rows over the smallest tables."""

import decimal

import duckdb
import pytest

from hypolake import queries as Q
from hypolake.session import TABLES

SQL = Q.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


def plain(v):
    return ("n", round(float(v), 7)) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, data, name):
    df = Q.queries()[name](spark, data)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert ours == theirs


def test_every_query_is_a_plan(spark, data):
    for name, query in Q.queries().items():
        if name not in SQL and not name.startswith(("l3", "l5", "l6", "m12", "c_scorer")):
            assert query(spark, data).columns
