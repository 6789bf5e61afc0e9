"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def rows(values, columns, order):
    def cell(v):
        return None if isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(cell(r[columns.index(c)]) for c in order) for r in values), key=repr)


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query_matches_its_sql(spark, db, name):
    frame = entry_points.queries()[name](spark, SF_DIR)
    got = [tuple(r) for r in frame.collect()]
    assert got
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        return
    expected = db.sql(sql)
    order = sorted(frame.columns)
    assert sorted(expected.columns) == order
    assert rows(got, frame.columns, order) == rows(expected.fetchall(), expected.columns, order)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 150
