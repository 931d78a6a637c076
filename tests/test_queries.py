"""Every query of the core runs on the smallest tables; those with SQL give the SQL's rows."""

import decimal
import os

import duckdb
import pytest

from quern.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
QUERIES, SQL = registry.collect("QUERIES"), registry.collect("SQL")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    d = QUERIES[name](spark, FOLDER)
    got = rows_of(d.columns, d.collect())
    if name in SQL:
        cursor = duck.cursor().execute(SQL[name])
        names = [x[0] for x in cursor.description]
        assert sorted(names) == sorted(d.columns)
        assert got == rows_of(names, cursor.fetchall())


def test_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)
