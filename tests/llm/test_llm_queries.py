"""Registered queries of the subpackage: with SQL against it, all of them for shape."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from stutter.llm import queries

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
OTHER_ROWS = {"op10_top_k", "op12_near_vectors", "op13_whitening", "op4_packing", "pipeline"}  # not one per document

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_registered():
    assert queries.QUERIES.keys() <= entry.queries().keys() and queries.ORACLES.keys() <= entry.oracle_sql().keys()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    sql = queries.ORACLES.get(name)
    if name not in OTHER_ROWS:
        assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert got
    if sql is None:
        return
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file[: -len('.parquet')]} AS SELECT * FROM '{FOLDER}/{file}'")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert {c: TYPES[t] for c, t in df.dtypes} == {d[0]: str(d[1]) for d in res.description}
    assert got == sorted(repr(tuple(row[names.index(c)] for c in cols)) for row in res.fetchall())
