"""Queries that SQL can express, against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from qscore.llm.oracles import ORACLES
from qscore.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "string": "VARCHAR"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(r[c] for c in columns) for r in df.collect())
    result = con.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[df.schema[c].dataType.simpleString()] for c in columns} == types
    place = [list(types).index(c) for c in columns]
    assert rows == sorted(tuple(r[i] for i in place) for r in result.fetchall())
