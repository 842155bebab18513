"""Every registered query of the fact operators against its SQL oracle."""

import numbers

import duckdb
import pandas as pd
import pytest

from factloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def text(v):
        if v is None or v is pd.NA or v != v:
            return "NULL"
        if isinstance(v, numbers.Number) and not isinstance(v, bool):
            return repr(round(float(v), 9))
        return str(v)

    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


def test_all_have_oracles():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_oracle(spark, oracle, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), oracle.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
