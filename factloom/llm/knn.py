"""Exact top-k inner-product search with a pivot-distance index.

Pivots are chosen from a bounded sample. Every vector of the table is indexed by
its nearest pivot and its distance to it; the index is range-partitioned and
sorted by (pivot, distance), so a run of neighbouring rows is an annulus around
a pivot and any number of equal rows is cut into runs of bounded size. A run
ends where the pivot changes or the distance falls, as at the seams of files.

A search takes the queries in blocks of at most ``QUERY_BLOCK`` that lie around
the same pivots, one block after the other: the driver holds one, and what each
finds is written. A block reads, of each cell of a pivot, the range of distances
in which one of its queries can have a result; both columns are sorted, so the
row groups of other cells and ranges aren't read. For a query q and an
annulus with distances in [lo, hi] around p and norms at most m, the triangle
inequality gives |q - x| >= max(d(q,p) - hi, lo - d(q,p), 0), hence
<q, x> <= (|q|^2 + m^2 - |q - x|^2) / 2; and <q, x> <= <q, p> + |q| hi.
Annuli are expanded from the best bound downwards and a query stops when its
k-th score so far is above every bound that is left. The k-th best score in the
sample is a first such floor for all tasks. Scores are integers, so results are
exact: sums that a double can't hold are made in extended precision, and vectors
whose scores could exceed 64 bits are an error.

Defined results: vectors that are null or hold null or non-finite components,
and rows without id take no part; products are those of equal dimensions, so each
dimension is searched for itself, and empty vectors have products of 0 with each
other; every row is a candidate of its own, also rows that repeat a vec_id, but
for queries of that id; query rows that repeat a vec_id share its ranks; ties go
to the smaller vec_id; with fewer than k candidates all are returned; extra
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import bound_batches, discard, materialize, release

#: Vectors from which pivots and first floors are taken, queries of a block, vectors of an annulus.
SAMPLE, QUERY_BLOCK, ANNULUS = 4096, 4096, 256
#: Pivots of small tables, and of large ones, which have one for so many of the square root's vectors.
PIVOTS, MOST_PIVOTS, PER_PIVOT = 64, 512, 64
#: Roundings of the bounds are below this share.
SLACK = 1e-9


def quantize(vector: Column) -> Column:
    """``floor(256 * x)`` of each component, as double before the product."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v, d`` of the rows that take part; an empty vector is one of a single zero, of dimension 0."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e")).where(
        F.col("vec_id").isNotNull()
        & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    whole = F.when(F.size("e") == 0, F.array(F.lit(0).cast("long"))).otherwise(quantize(F.col("e")))
    return rows.select("vec_id", whole.alias("v"), F.size("e").alias("d"))


def _dimensions(rows: DataFrame) -> list[tuple[int, np.dtype, int]]:
    """The dimensions that occur, with the kind of number that holds their products exactly and their rows."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    found = rows.groupBy("d").agg(F.max(square).alias("most"), F.count("*").alias("n")).orderBy("d").collect()
    if any(r["most"] >= 2.0**63 for r in found):
        raise ValueError("the vectors are so long that their products exceed 64 bits")
    # a distance has four times the square of a length
    return [(r["d"], np.dtype(np.float64 if r["most"] < 2.0**51 else np.longdouble), r["n"]) for r in found]


def pivots_for(rows: int) -> int:
    """How many pivots a table of so many rows gets."""
    return max(PIVOTS, min(MOST_PIVOTS, math.isqrt(rows) // PER_PIVOT))


def _matrix(column: pa.ListArray, d: int, kind: np.dtype = np.dtype(np.float64)) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(kind)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances; the squares are sums of integers below 2^53 and so exact."""
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def build_index(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vec_id, v, pivot, distance``, range-partitioned and sorted into annuli."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)
    bound_batches(rows.sparkSession)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_matrix(b.column(1), held.value.shape[1], held.value.dtype), held.value)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near].astype(np.float64))],
                    names=["vec_id", "v", "pivot", "distance"],
                )

    keys = ("pivot", "distance", "vec_id")
    return (
        rows.mapInArrow(assign, "vec_id long, v array<long>, pivot int, distance double")
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
    )


class QueryBlock:
    """A bounded number of queries with their floors."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.norm2 = (q * q).sum(1)
        self.floor = np.full(len(q), -np.inf, q.dtype)
        if len(sample) > k:
            scores = np.where(sample_ids[None, :] == ids[:, None], -np.inf, q @ sample.T)
            self.floor = np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]


def _upper(block: QueryBlock, to_pivots: np.ndarray, products: np.ndarray, annuli: list[tuple]) -> np.ndarray:
    """Bounds of the scores of each query (column) in each annulus (row)."""
    p = np.array([a[0] for a in annuli])
    lo, hi, most = (np.array([a[i] for a in annuli])[:, None] for i in (1, 2, 3))
    d = to_pivots[:, p].T
    gap = np.maximum(np.maximum(d - hi, lo - d), 0)
    by_triangle = (block.norm2[None, :] + most - gap * gap) / 2
    by_product = products[:, p].T + np.sqrt(block.norm2)[None, :] * hi
    return np.minimum(by_triangle, by_product) + SLACK * (block.norm2[None, :] + most + 1)


def _search(batches: Iterator[pa.RecordBatch], block: QueryBlock, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    n, k, d = len(block.ids), block.k, block.q.shape[1]
    best = np.full((n, k), -np.inf, block.q.dtype)
    who = np.full((n, k), np.iinfo(np.int64).max)
    to_pivots, products = _distances(block.q, pivots), block.q @ pivots.T
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0).to_numpy()
        x, pivot, distance = _matrix(b.column(1), d, block.q.dtype), b.column(2).to_numpy(), b.column(3).to_numpy()
        norm2 = (x * x).sum(1)
        # a read partition may hold several files of the index in any order, so a run also ends where the distance falls
        cuts = np.flatnonzero((np.diff(pivot, prepend=pivot[0] - 1) != 0) | (np.diff(distance, prepend=distance[0]) < 0))
        annuli = []
        for a, z in zip(cuts, np.append(cuts[1:], len(ids)), strict=True):
            for s in range(a, z, ANNULUS):
                e = min(s + ANNULUS, z)
                annuli.append((pivot[s], distance[s], distance[e - 1], norm2[s:e].max(), s, e))
        upper = _upper(block, to_pivots, products, annuli)
        for at in np.argsort(-upper.max(1), kind="stable"):
            _, _, _, _, s, e = annuli[at]
            live = np.flatnonzero(upper[at] >= np.maximum(block.floor, best[:, -1]))
            if not live.size:
                continue
            scores = block.q[live] @ x[s:e].T
            scores[ids[s:e][None, :] == block.ids[live][:, None]] = -np.inf
            joint = np.concatenate([best[live], scores], axis=1)
            names = np.concatenate([who[live], np.broadcast_to(ids[s:e], scores.shape)], axis=1)
            names = np.where(joint == -np.inf, np.iinfo(np.int64).max, names)
            order = np.lexsort((names, -joint), axis=1)[:, :k]
            best[live] = np.take_along_axis(joint, order, 1)
            who[live] = np.take_along_axis(names, order, 1)
    row, col = np.nonzero((best > -np.inf) & (best >= block.floor[:, None]))
    for s in range(0, len(row), 10_000):
        r, c = row[s : s + 10_000], col[s : s + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.ids[r]), pa.array(who[r, c]), pa.array(best[r, c].astype(np.int64))],
            names=["query_id", "vec_id", "score"],
        )


def plan_blocks(counts: dict[int, int], pivots: np.ndarray) -> list[tuple[list[int], int, int]]:
    """Blocks as (pivots, part, parts) of at most ``QUERY_BLOCK`` queries, or so by hash where one pivot has more.

    Pivots are taken in an order in which each is the nearest to the one before it.
    """
    left, order = sorted(counts), []
    while left:
        if order:
            near = _distances(pivots[order[-1:]], pivots[left])[0]
            order.append(left.pop(int(near.argmin())))
        else:
            order.append(left.pop(0))
    blocks: list[tuple[list[int], int, int]] = []
    names, size = [], 0
    for p in order:
        if names and size + counts[p] > QUERY_BLOCK:
            blocks.append((names, 0, 1))
            names, size = [], 0
        if counts[p] > QUERY_BLOCK:
            parts = -(-counts[p] // QUERY_BLOCK)
            blocks += [([p], i, parts) for i in range(parts)]
        else:
            names.append(p)
            size += counts[p]
    return [*blocks, (names, 0, 1)] if names else blocks


def _cells(index: DataFrame) -> list[tuple]:
    """``(pivot, least and greatest distance, greatest square of a length)`` of each pivot's cell."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = index.groupBy("pivot").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.max(square).alias("most"))
    return [(r["pivot"], r["lo"], r["hi"], r["most"]) for r in rows.collect()]


def _reach(block: QueryBlock, pivots: np.ndarray, cells: list[tuple]) -> Column:
    """The rows of the index that a query of the block may have as a result: a range of distances of each cell.

    With a floor f a result x has |q - x|^2 <= |q|^2 + m^2 - 2 f, and so lies that
    near to the query's own distance from the pivot. Neighbouring cells of which
    everything is read are one condition.
    """
    to_pivots = _distances(block.q, pivots)
    upper = _upper(block, to_pivots, block.q @ pivots.T, cells)
    whole: list[int] = []
    found = F.lit(False)
    for (pivot, low, high, most), bound in zip(cells, upper, strict=True):
        live = bound >= block.floor
        if not live.any():
            continue
        room = block.norm2[live] + most - 2 * block.floor[live]
        room = np.sqrt(np.maximum(room + SLACK * (block.norm2[live] + most + 1), 0))
        d = to_pivots[live, int(pivot)]
        least, last = float((d - room).min()), float((d + room).max())
        if least <= low and last >= high:
            whole.append(int(pivot))
        else:
            found = found | ((F.col("pivot") == int(pivot)) & F.col("distance").between(max(least, 0.0), last))
    return (F.col("pivot").isin(whole) | found) if whole else found


def search(
    vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` highest integer products of each query row with all other rows.

    ``queries`` is a condition on ``vec_id``. ``query_id, rank, vec_id, score``.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    found = [_search_dimension(rows.where(F.col("d") == d).drop("d"), queries, k, max(d, 1), kind, n) for d, kind, n in _dimensions(rows)]
    found = [df for df in found if df is not None]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if len(found) == 1:
        return found[0]
    # a query id whose rows have several dimensions ranks over all of them
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w))
    return every.where(F.col("rank") <= k)


def _search_dimension(rows: DataFrame, queries: Column, k: int, d: int, kind: np.dtype, n: int) -> DataFrame | None:
    """The results among vectors of one dimension; None without queries."""
    spark = rows.sparkSession
    # a bounded sample: at most SAMPLE vectors reach the driver
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    sample_ids = sample.column(0).to_numpy()
    points = _matrix(sample.column(1).combine_chunks(), d, kind)
    pivots = choose_pivots(points, pivots_for(n))
    index = materialize(build_index(rows, pivots), "annuli")
    asked = index.where(queries)
    counts = {r["pivot"]: r["count"] for r in asked.groupBy("pivot").count().collect()}  # a row for each pivot
    if not counts:
        return None
    blocks = plan_blocks(counts, pivots)
    cells = _cells(index) if len(blocks) > 1 else []
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    written: list[DataFrame] = []
    for names, part, parts in blocks:
        mine = asked.where(F.col("pivot").isin(names))
        if parts > 1:
            mine = mine.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(parts)) == part)
        got = mine.select("vec_id", "v").orderBy("vec_id").toArrow()
        if not got.num_rows:
            continue
        block = QueryBlock(
            got.column(0).to_numpy(), _matrix(got.column(1).combine_chunks(), d, kind), sample_ids, points, k
        )
        held = spark.sparkContext.broadcast((block, pivots))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            try:
                yield from _search(batches, *held.value)
            finally:
                release()

        reached = index
        if len(blocks) > 1:
            reached = index.where(_reach(block, pivots, cells))
        found = reached.mapInArrow(run, "query_id long, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        found = found.select("query_id", "rank", "vec_id", "score")
        if len(blocks) == 1:
            return found
        written.append(materialize(found, "found"))
        held.destroy()
    discard(index)
    return spark.read.schema(written[0].schema).parquet(*(f.rpartition("/")[0] for df in written for f in df.inputFiles()[:1]))
