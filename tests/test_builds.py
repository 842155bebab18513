"""Builds of more suppliers than the driver's smallest table has: beyond the limits of families and the usual height of the world."""

import os
from urllib.parse import urlparse

import duckdb
import pytest

from factloom.plans.registry import ORACLES, QUERIES

N = 1300


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    folder = tmp_path_factory.mktemp("wide")
    duckdb.sql(f"COPY (SELECT range AS s_suppkey, 'Supplier#' || range AS s_name, CAST(range % 25 AS INTEGER) AS s_nationkey, 1.0 AS s_acctbal FROM range({N})) TO '{folder}/supplier.parquet' (FORMAT parquet)")
    return str(folder)


def compared(spark, folder, name, **tables):
    con = duckdb.connect()
    for t in [f for f in os.listdir(folder) if f.endswith(".parquet")]:
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{folder}/{t}'")
    got = QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.select(*columns).collect())), sorted(want)


@pytest.mark.parametrize("name", ["oracle_lookups", "trace_dialogues", "trace_families", "training_set_rows", "oracle_table_counts", "evaluation_items"])
def test_wide_build(spark, wide, name):
    got, want = compared(spark, wide, name)
    assert got == want


def test_few_files(spark, wide):
    """A report of more than 10,000 documents isn't as many files."""
    shared = urlparse(spark.conf.get("spark.checkpoint.dir")).path
    files = lambda: sum(len(f) for _, _, f in os.walk(shared))
    from factloom.plans import builds

    assert builds._report(spark, wide).count() > 10_000
    builds._built.clear()
    before = files()
    builds._build(spark, wide)
    assert files() - before < 2_000


def test_usage_cap_beyond_a_million(spark, tmp_path):
    """The first order has the first place of a large part and the second one of a small part, which weighs less."""
    duckdb.sql(f"COPY (SELECT * FROM (VALUES (1::BIGINT, 50000::BIGINT), (2, 50000), (2, 1100000), (3, 1100000)) AS t(l_orderkey, l_partkey)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got, want = compared(spark, str(tmp_path), "usage_cap")
    assert got == want == [(1, 50000), (2, 50000), (3, 1100000)]


def test_paths_write_new_pairs_alone(spark, monkeypatch):
    """Paths of a ladder and of a cycle; no round writes what an earlier one has found."""
    from factloom.operators import graph

    wrote = {}

    def counted(df, name):
        out = written(df, name)
        wrote[name] = wrote.get(name, 0) + out.count()
        return out

    written = graph.written
    monkeypatch.setattr(graph, "written", counted)
    edges = [(i, i + 1) for i in range(20)] + [(i, i + 2) for i in range(19)] + [(100, 101), (101, 102), (102, 100)]
    got = {tuple(r) for r in graph.paths(spark.createDataFrame(edges, "tag long, ref long")).collect()}
    assert got == {(i, j) for i in range(20) for j in range(i + 1, 21)} | {(i, j) for i in (100, 101, 102) for j in (100, 101, 102)}
    assert wrote["found"] == len(got)


def test_documents_are_made_in_many_tasks(spark, small, monkeypatch):
    """The parts lie in one small file; the work on their documents isn't one task."""
    from factloom.plans import base, documents, records

    monkeypatch.setattr(base, "TASK_ROWS", 50)
    monkeypatch.setattr(base.spread, "__defaults__", (50,))
    for docs in (records.report_documents(spark, small), records.pack_documents(spark, small), documents._docs(spark, small, "'{}'")):
        assert len(docs.inputFiles()) > 1


def test_near_pairs_of_a_dense_cell(spark, monkeypatch):
    """Many pairs of few points are cut by the number of pairs."""
    from factloom.operators import relations

    monkeypatch.setattr(relations, "TASK_PAIRS", 100)
    points = lambda n, x: spark.range(n).selectExpr("id", f"{x} + id * 0.001 AS x", "0.0 AS y", "0.0 AS z")
    found = relations.near_pairs(points(60, 0.1), points(40, 0.1), 1.0)
    assert found.count() == 60 * 40
    most = max(len(p) for p in found.rdd.glom().collect())
    assert most < 60 * 40 / 2


def test_near_pairs_of_a_position_lie_side_by_side(spark):
    """Pairs of the same two positions follow each other, so that what is written of many copies stays small."""
    from itertools import groupby

    from factloom.operators import relations

    points = lambda n: spark.range(n).selectExpr("nullif(id, 0) AS id", "id % 4 * 0.01 AS x", "if(id = 1, null, 0.0) AS y", "0 AS z")
    parts = relations.near_pairs(points(120), points(80), 1.0).rdd.glom().collect()
    assert sum(len(list(groupby(p, key=lambda r: r.distance))) for p in parts) <= 16
    found = relations.near_pairs(points(120), points(80), 1.0, 1)
    assert found.count() == 119 * 79 and found.where("a_id IS NULL").count() == 79 and found.where("b_id IS NULL").count() == 119
    assert found.where("distance <> 0").isEmpty()


def test_near_pairs_shuffle_with_their_pairs(spark, monkeypatch):
    """Both sides of a crowded position are cut, and each is shuffled once."""
    from factloom.operators import relations

    shuffled, frame = [], type(spark.range(1))
    repartition = frame.repartition
    monkeypatch.setattr(relations, "TASK_PAIRS", 100)
    monkeypatch.setattr(frame, "repartition", lambda self, *a: (shuffled.append(self.count()), repartition(self, *a))[1])
    points = lambda n: spark.range(n).selectExpr("id", "0.5 AS x", "0.5 AS y", "0.5 AS z")
    found = relations.near_pairs(points(50), points(400), 1.0)
    assert sum(shuffled) < 50 * 400
    assert "ENSURE_REQUIREMENTS" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == found.distinct().count() == 50 * 400