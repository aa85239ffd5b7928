"""Every registered query against its SQL, on whole tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name[: -len('.parquet')]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query(spark, db, name):
    df = entry.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    sql = entry.ORACLES.get(name)
    if sql is None:
        assert got
        return
    res = db.execute(sql)
    types = {d[0]: str(d[1]) for d in res.description}
    names = [d[0] for d in res.description]
    want = sorted(repr(tuple(row[names.index(c)] for c in cols)) for row in res.fetchall())
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
