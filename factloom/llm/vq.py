"""Vector code compression: product codes whose codebooks come from the filtering form of Lloyd's method.

Components become integers, vectors are cut into equal consecutive parts, and every
part position has a codebook. Each partition plants its rows once, in blocks of at
most ``BLOCK`` rows: a kd-tree for each part position whose nodes hold their
bounding box and the sum and number of their parts. The trees are written to the
shared folder; every round reads them, so a lost executor costs one task's read.

A round walks the trees from the root with the entries that may still be nearest
to some part in the box. An entry goes if the one nearest to the box's middle is
nearer at that corner of the box which favours the other most, or as near and of
lower index. Where one entry is left the whole subtree is its own, by the cached
sums and counts; only parts in leaves with several entries left are compared one
by one. All of it is integer arithmetic, so results are those of plain Lloyd.
A task sends its sums, ``entries * (dimension + parts)`` numbers, which Spark adds up; the
driver holds codebooks alone.

Defined results: rows whose vector is null or holds a null or a component that
isn't finite are dropped. Codebooks are made for one dimension, that of most rows
among those which the parts divide (of equally frequent ones the largest); rows of
another one, empty vectors too, stay without code and error. Rows that repeat a
vec_id are rows of their own; the first entries are the smallest (vec_id, vector),
nulls last, fewer where there are fewer rows. A null label is a label. Vectors so
long that squared distances exceed 64 bits are an error. Extra columns are ignored,
and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bound_batches, column_of, discard, materialize, release, scratch_path

#: Rows of a block, parts of a leaf.
BLOCK, LEAF = 4096, 16
#: Labels whose sums are broadcast; beyond it the join is shuffled.
BROADCAST_LABELS = 100_000
_FAR = np.iinfo(np.int64).max


class Tree:
    """A kd-tree in levels: node j of a level has the nodes 2j and 2j + 1 of the next."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        order, starts = np.arange(n), np.array([0, n])
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            held, heads, sizes = points[order], starts[:-1], np.diff(starts)
            low, high = np.minimum.reduceat(held, heads), np.maximum.reduceat(held, heads)
            self.levels.append((starts, low, high, np.add.reduceat(held.astype(np.int64), heads)))
            if sizes.max() <= LEAF:
                break
            node = np.repeat(np.arange(len(heads)), sizes)
            widest = (high.astype(np.int64) - low).argmax(1)
            order = order[np.lexsort((held[np.arange(n), widest[node]], node))]
            starts = np.sort(np.concatenate([starts, (starts[:-1] + starts[1:]) // 2]))
        self.order, self.points = order, held

    def assign(self, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """What goes to entries: (first rows, ends, entries, sums), rows in the order of the tree."""
        index = np.arange(len(book))
        node, alive = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        for starts, lows, highs, sums in self.levels:
            low, high = lows[node].astype(np.int64)[:, None], highs[node].astype(np.int64)[:, None]
            middle = np.square(2 * book - (low + high)).sum(2)
            middle[~alive] = _FAR
            star = middle.argmin(1)
            best = book[star][:, None]
            corner = np.where(book > best, high, low)
            gap = np.square(book - corner).sum(2) - np.square(best - corner).sum(2)
            alive &= (gap < 0) | ((gap == 0) & (index <= star[:, None]))
            alone = alive.sum(1) == 1
            mine = node[alone]
            yield starts[mine], starts[mine + 1], star[alone], sums[mine]
            node, alive = node[~alone], alive[~alone]
            if not len(node):
                return
            last = node, alive
            node, alive = np.stack([2 * node, 2 * node + 1], 1).ravel(), np.repeat(alive, 2, 0)
        starts = self.levels[-1][0]
        node, alive = last
        sizes = starts[node + 1] - starts[node]
        rows = np.repeat(starts[node] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        held = self.points[rows].astype(np.int64)
        far = np.square(held[:, None] - book).sum(2)
        far[~np.repeat(alive, sizes, 0)] = _FAR
        yield rows, rows + 1, far.argmin(1), held

    def entries(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row, in the rows' own order."""
        found = np.empty(len(self.order), np.int64)
        for first, end, entry, _ in self.assign(book):
            found[_ranges(first, end)] = np.repeat(entry, end - first)
        far = np.square(self.points.astype(np.int64) - book[found]).sum(1)
        out, error = np.empty_like(found), np.empty_like(far)
        out[self.order], error[self.order] = found, far
        return out, error

    def gather(self, book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Add the parts of every entry to its sum and count."""
        for first, end, entry, total in self.assign(book):
            np.add.at(sums, entry, total)
            np.add.at(counts, entry, end - first)


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    sizes = end - first
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def quantize(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def plant(rows: DataFrame, parts: int) -> DataFrame:
    """``ids, labels, trees`` of each block of ``vec_id, label, v`` rows, written.

    Row groups are bounded in rows, so that a reader holds few blocks.
    """
    spark = rows.sparkSession
    bound_batches(spark)

    def block(rows: pa.Table) -> pa.RecordBatch:
        n = rows.num_rows
        flat = rows.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, parts, -1)
        small = flat.size and np.abs(flat).max() < 1 << 31
        trees = [pickle.dumps(Tree(flat[:, i].astype(np.int32 if small else np.int64)), 5) for i in range(parts)]
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [one(rows.column(0).combine_chunks()), one(rows.column(1).combine_chunks()), one(pa.array(trees, pa.binary()))],
            names=["ids", "labels", "trees"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            while b.num_rows:
                take = b.slice(0, BLOCK - size)
                held.append(take)
                size += take.num_rows
                b = b.slice(take.num_rows)
                if size == BLOCK:
                    yield block(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield block(pa.Table.from_batches(held))
        release()

    kind = dict(rows.dtypes)["label"]
    planted = rows.mapInArrow(run, f"ids array<long>, labels array<{kind}>, trees array<binary>")
    path = scratch_path(spark, "trees")
    planted.write.option("parquet.block.row.count.limit", "8").parquet(path)
    return spark.read.schema(planted.schema).parquet(path)


def refine(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all trees; entries without parts stay."""
    parts, entries, d = books.shape
    held = trees.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, d), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for block in range(b.num_rows):
                for i, tree in enumerate(b.column(0).slice(block, 1).flatten()):
                    pickle.loads(tree.as_py()).gather(held.value[i], sums[i], counts[i])
        if counts.any():
            cells = np.concatenate([sums, counts[:, :, None]], 2).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "value"])
        release()

    added = trees.select("trees").mapInArrow(run, "cell long, value long")
    # as many rows as the codebooks have components and entries, whatever the table's size
    cells = {r["cell"]: int(r["s"]) for r in added.groupBy("cell").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("s")).collect()}
    held.destroy()
    out = books.copy()
    for at in range(parts * entries):
        *sums, count = (cells[at * (d + 1) + i] for i in range(d + 1))
        if count:
            out[at // entries, at % entries] = [s // count for s in sums]
    return out


def encode(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every planted row."""
    held = trees.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in range(b.num_rows):
                ids, labels, trees = (c.slice(block, 1).flatten() for c in b.columns)
                codes, errors = zip(*(pickle.loads(t.as_py()).entries(book) for t, book in zip(trees, held.value, strict=True)), strict=True)
                text = [bytes(row).hex() for row in np.stack(codes, 1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array(text), pa.array(np.sum(errors, 0))], names=["vec_id", "label", "code", "error"]
                )
        release()

    kind = dict(trees.dtypes)["labels"].removeprefix("array")[1:-1]
    return trees.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(
    vectors: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row that isn't dropped; at most 256 entries."""
    rows = vectors.select(
        column_of(id_col).cast("long").alias("vec_id"), column_of(label_col).alias("label"), column_of(vector_col).alias("e")
    ).where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    longest = F.max(F.coalesce(F.array_max(F.transform("e", lambda x: F.abs(x.cast("double")))), F.lit(0.0)))
    sizes = rows.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n"), longest.alias("most"))
    top = sizes.where((F.col("d") > 0) & (F.col("d") % parts == 0)).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d, most = (top[0]["d"], scale * top[0]["most"] + 1) if top else (0, 0)
    if 16 * d * most * most >= 2.0**63:
        raise ValueError("the vectors are so long that squared distances exceed 64 bits")
    whole = rows.where(F.size("e") == d).select("vec_id", "label", quantize(F.col("e"), scale).alias("v")) if top else None
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect() if top else []
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2) if first else None
    other = rows.where(F.size("e") != d) if top else rows
    other = other.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = other
    if top:
        trees = plant(whole, parts)
        for _ in range(rounds):
            books = refine(trees, books)
        coded = encode(trees, books).unionByName(other)
    coded = materialize(coded, "codes")
    if top:
        discard(trees)
    by_label = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    if by_label.count() <= BROADCAST_LABELS:
        by_label = F.broadcast(by_label)
    digits = ",".join(map(str, books.ravel().tolist())) if top else ""
    return (
        coded.alias("x")
        .join(by_label.alias("y"), F.col("x.label").eqNullSafe(F.col("y.label")), "left")
        .select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(digits.encode()).hexdigest()).alias("codebooks_sha256"))
    )
