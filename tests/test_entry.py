"""Registered queries: names, SQL for the core's own, schemas, the smoke query."""

import duckdb
import pytest

import __spark_entry__ as entry
from loomql import queries as core
from loomql import stored_queries as stored

QUERIES, ORACLES = core.QUERIES | stored.QUERIES, core.ORACLES | stored.ORACLES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_names():
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(found) and set(ORACLES) == set(QUERIES) and set(sql) <= set(found)


def test_smoke(spark):
    assert entry.entry(spark).count() == 5


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, database, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = database.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
