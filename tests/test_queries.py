"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire import plans

DATA = os.environ.get("QUIRE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(want.columns) == columns
    kinds = dict(df.dtypes)
    assert [SQL_TYPES[kinds[c]] for c in columns] == [str(want.types[want.columns.index(c)]) for c in columns]
    place = [want.columns.index(c) for c in columns]
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert got == sorted(repr(tuple(r[i] for i in place)) for r in want.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_rows_come(spark, name):
    assert plans.QUERIES[name](spark, DATA).count()


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "chapter_no", "title", "file_name", "n_chars"]
    assert set(plans.ORACLES) <= set(entry.oracle_sql()) and set(plans.QUERIES) <= set(entry.queries())
