"""Product codes against plain Lloyd over all parts and entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from factloom.llm import vq


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, code, error, label_error, digest) of (vec_id, vector, label) rows of one dimension."""
    kept = [(i, [math.floor(scale * float(x)) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def nearest(p, part):
        return min(((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(books[p])))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(p, c[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(g) for x in zip(*g, strict=True)] if (g := groups.get(j)) else e for j, e in enumerate(books[p])]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(f for f, _ in x) for x in found]
    total = {}
    for (_, _, c), e in zip(kept, errors, strict=True):
        total[c] = total.get(c, 0) + e
    return [(i, "".join(f"{j:02x}" for _, j in f), e, total[c], digest) for (i, _, c), f, e in zip(kept, found, errors, strict=True)]


SCHEMA = "vec_id long, embedding array<float>, label int, code string, `a.b` int"


def rows_of(made):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c, "x", 1) for i, v, c in made]


def made(n, d, seed):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(d)] for _ in range(5)]
    out = [(k * 3 - 20, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.choice([0, 1, 2, None])) for k in range(n)]
    out += [(500 + k, centres[0], 7) for k in range(n // 4)]  # copies
    out += [(5, [0.25] * d, 1), (5, [-0.25] * d, 1), (None, [0.5] * d, 2)]
    return out


@pytest.mark.parametrize("d,block", [(16, 64), (8, 4096), (24, 17)])
def test_equals_plain_lloyd(spark, monkeypatch, d, block):
    monkeypatch.setattr(vq, "BLOCK", block)
    rows = rows_of(made(160, d, d))
    odd = [(1001, None, 1), (1002, [None] * d, 1), (1003, [float("nan")] * d, 1), (1004, [float("inf")] + [0.0] * (d - 1), None)]
    df = spark.createDataFrame(rows + rows_of(odd), SCHEMA).repartition(3)
    got = sorted(map(tuple, vq.compress(df).collect()), key=str)
    assert got == sorted(plain([r[:3] for r in rows]), key=str)


def test_trees_assign_as_all_comparisons_do():
    rng = np.random.default_rng(1)
    for n, d, spread in ((1, 2, 9), (300, 1, 3), (1000, 3, 4), (2000, 8, 4000), (500, 2, 1)):
        points = rng.integers(-spread, spread + 1, (n, d))
        tree = vq.Tree(points.astype(np.int32))
        for book in (rng.integers(-spread, spread + 1, (16, d)), points[:1].repeat(3, 0)):
            far = np.square(points[:, None] - book).sum(2)
            entry, error = tree.entries(book)
            assert (entry == far.argmin(1)).all() and (error == far.min(1)).all()
            sums, counts = np.zeros_like(book), np.zeros(len(book), np.int64)
            tree.gather(book, sums, counts)
            assert (counts == np.bincount(entry, minlength=len(book))).all()
            assert all((sums[j] == points[entry == j].sum(0)).all() for j in range(len(book)))


def test_whole_subtrees_are_assigned_at_once():
    points = np.concatenate([np.random.default_rng(k).integers(0, 9, (500, 4)) + 1000 * k for k in range(4)])
    taken = list(vq.Tree(points).assign(np.arange(4)[:, None] * 1000 + np.zeros((1, 4), np.int64)))
    assert sum(len(first) for first, *_ in taken) == 4  # a subtree for each of four clusters, no point by itself


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vq.compress(empty).count() == 0
    few = rows_of([(3, [0.1] * 8, None), (1, [0.2] * 8, 4)])
    assert sorted(map(tuple, vq.compress(spark.createDataFrame(few, SCHEMA)).collect())) == sorted(plain([r[:3] for r in few]))
    mixed = spark.createDataFrame([*few, *rows_of([(7, [0.5] * 7, 4), (8, [], None), (9, [1.0] * 16, 4)])], SCHEMA)
    got = {r.vec_id: r for r in vq.compress(mixed).collect()}
    assert len(got) == 5 and {i for i, r in got.items() if r.code is None} == {7, 8, 9}
    assert got[7].label_error == got[1].error == got[1].label_error and got[7].error is None
    only = spark.createDataFrame(rows_of([(7, [0.5] * 7, 4)]), SCHEMA)
    assert [(r.vec_id, r.code) for r in vq.compress(only).collect()] == [(7, None)]
    with pytest.raises(ValueError):
        vq.compress(spark.createDataFrame(rows_of([(7, [1e30] * 8, 4)]), SCHEMA))


def test_many_labels_are_joined_by_shuffle(spark, monkeypatch):
    rows = rows_of(made(60, 8, 3))
    want = sorted(plain([r[:3] for r in rows]), key=str)
    monkeypatch.setattr(vq, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, vq.compress(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == want


def test_table(spark, small):
    from factloom.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_codes"](spark, small).collect())) == sorted(plain(rows))
