"""Corpus queries against their SQL."""

import duckdb
import pytest

from factloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got, want = QUERIES[name](spark, small), con.execute(ORACLES[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.columns) == columns
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(zip(*(want.column(c).to_pylist() for c in columns), strict=True), key=key)
