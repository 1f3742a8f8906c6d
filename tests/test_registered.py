"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from qscore.plans.oracles import ORACLES
from qscore.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
# Many diffs fit the same two versions; those of this query are held by patched_files and by tests.
ROWS_ONLY = {"scan_files", "unified_diffs"}
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert rows
    if name in ROWS_ONLY:
        return
    result = duck.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[df.schema[c].dataType.simpleString()] for c in columns} == types
    place = [list(types).index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in place) for r in result.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "repo", "static", "architecture", "verification", "security", "total",
    ]
