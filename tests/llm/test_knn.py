"""Exact search against all products."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import knn


def plain(rows, k=5):
    """Every row but those of the query's id, of the same dimension; rows of a query id rank together."""
    kept = [
        (i, [math.floor(256 * float(x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    scores = {}
    for q, a in kept:
        if q % 50 == 0:
            scores.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in kept if j != q and len(a) == len(b))
    return sorted((q, r + 1, j, -s) for q, found in scores.items() for r, (s, j) in enumerate(sorted(found)[:k]))


@pytest.mark.parametrize("block", [4096, 3])
def test_equals_all_products(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "QUERY_BLOCK", block)
    monkeypatch.setattr(knn, "SAMPLE", 40)
    monkeypatch.setattr(knn, "PIVOTS", 7)
    monkeypatch.setattr(knn, "ANNULUS", 8)
    random.seed(4)
    rows = [(i, [random.gauss(0, 0.3) for _ in range(6)]) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(2000, None), (2001, [1.0, None] + [0.0] * 4), (2050, [float("nan")] * 6), (50, rows[50][1]), (None, [0.1] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    assert sorted(map(tuple, knn.search(df, F.col("vec_id") % 50 == 0).collect())) == plain(rows)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in knn.search(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 7, 256 * 128)]
    assert knn.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert knn.search(df.where("vec_id = 7"), F.col("vec_id") % 50 == 0).count() == 0


def test_files_of_a_hot_pivot_read_out_of_order():
    # two files of the index in one batch: the far rows of the only pivot's cell lie before the near ones
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(0, 1, (40, 8)))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None] * np.linspace(0.1, 3, 40)[:, None])
    pivots = np.zeros((1, 8))
    distance = knn._distances(x, pivots)[:, 0]
    order = np.argsort(distance)
    order = np.concatenate([order[20:], order[:20]])
    flat = pa.array(x[order].astype(np.int64).ravel())
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, 41 * 8, 8, dtype=np.int32)), flat)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(order.astype(np.int64)), vectors, pa.array(np.zeros(40, np.int32)), pa.array(distance[order])],
        names=["vec_id", "v", "pivot", "distance"],
    )
    block = knn.QueryBlock(np.arange(40), x, np.arange(40), x, 5)
    got = {}
    for b in knn._search(iter([batch]), block, pivots):
        for q, v, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got.setdefault(q, []).append((-s, v))
    scores = (x @ x.T).astype(int)
    want = {q: sorted((-int(scores[q, j]), j) for j in range(40) if j != q)[:5] for q in range(40)}
    assert {q: sorted(v) for q, v in got.items()} == want


def test_products_beyond_doubles_are_exact(spark):
    # products of some 2^60 that differ by one
    rows = [(0, [2.0**22, 3.0]), (1, [2.0**22, 1.0 / 256]), (2, [2.0**22, 2.0 / 256]), (3, [2.0**22, 0.0]), (4, [-(2.0**22), 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, knn.search(df, F.col("vec_id") % 50 == 0).collect())) == plain(rows)


def test_products_beyond_64_bits_are_refused(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        knn.search(df, F.col("vec_id") % 50 == 0)


def test_blocks_hold_all_queries_once():
    pivots = np.arange(12, dtype=float).reshape(6, 2)
    counts = {0: 10, 1: 5000, 2: 4000, 4: 90, 5: 9000}
    blocks = knn.plan_blocks(counts, pivots)
    seen = {}
    for names, part, parts in blocks:
        assert parts > 1 and len(names) == 1 or sum(counts[p] for p in names) <= knn.QUERY_BLOCK
        for p in names:
            seen.setdefault(p, []).append((part, parts))
    assert {p: sorted(x) for p, x in seen.items()} == {0: [(0, 1)], 1: [(0, 2), (1, 2)], 2: [(0, 1)], 4: [(0, 1)], 5: [(i, 3) for i in range(3)]}


def test_cells_without_results_are_not_read(spark, monkeypatch):
    """Two far clusters: a block of the one's queries never needs the other."""
    monkeypatch.setattr(knn, "QUERY_BLOCK", 2)
    monkeypatch.setattr(knn, "PIVOTS", 2)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(5 if i % 2 else -5, 0.05, 4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, knn.search(df, F.col("vec_id") % 25 == 0).collect())) == sorted(
        (q, r + 1, j, -s)
        for q, a in quantized(rows).items()
        if q % 25 == 0
        for r, (s, j) in enumerate(sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in quantized(rows).items() if j != q)[:5])
    )


def quantized(rows):
    return {i: [math.floor(256 * x) for x in v] for i, v in rows}


def test_repeated_ids_other_dimensions_and_empty_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, [2.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (50, [1.0, 1.0]), (50, [-1.0, 0.0]), (0, [3.0]), (2, [1.0]), (3, [-1.0]), (100, []), (4, []), (5, []), (150, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, knn.search(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == plain(rows)
    assert [r[2:] for r in got if r[0] == 0][:3] == [(2, 3 * 65536), (1, 131072), (50, 98304)]


def test_repeated_ids_equal_the_sql(spark):
    import duckdb
    import pandas as pd

    from factloom.llm.queries import ORACLES

    rows = [(0, [1.0, 0.5]), (1, [2.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (50, [1.0, 1.0]), (50, [-1.0, 0.0])]
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding"])  # noqa: F841
    want = duckdb.sql(ORACLES["op4_topk"]).fetchall()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, knn.search(df, F.col("vec_id") % 50 == 0).collect())) == sorted(want)


def test_far_distances_are_not_read(spark, monkeypatch):
    """Shells around one pivot: a block of queries reads the ranges of distances that they reach, and loses nothing."""
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3)
    monkeypatch.setattr(knn, "PIVOTS", 2)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        v = rng.normal(0, 1, 4)
        rows.append((i, [float(x) for x in v / np.linalg.norm(v) * (0.2 if i % 3 else 8 + i % 7)]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked, made = [], knn._reach

    def reach(block, pivots, cells):
        asked.append(made(block, pivots, cells))
        return asked[-1]

    monkeypatch.setattr(knn, "_reach", reach)
    assert sorted(map(tuple, knn.search(df, F.col("vec_id") % 50 == 0).collect())) == plain(rows)
    assert len(asked) > 1 and any("between" in str(c).lower() or "distance" in str(c).lower() for c in asked)


def test_pivots_grow_with_the_table():
    assert [knn.pivots_for(n) for n in (10, 10**6, 10**8, 10**9, 10**12)] == [64, 64, 156, 494, 512]
