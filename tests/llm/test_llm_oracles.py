"""Operators that SQL can express give the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pytest

from galena.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, key):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, expected = QUERIES[key](spark, DATA), c.sql(ORACLES[key])
    assert sorted(df.columns) == sorted(expected.columns)
    names = expected.columns
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, expected.fetchall()))
