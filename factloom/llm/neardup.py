"""Near-duplicates by an inverted join over signature coordinates.

A document's set is its distinct shingles of ``words`` words; two documents are
linked if the sets' Jaccard similarity is at least 0.8, confirmed on the full
sets. Equal sets are one class first, so copies cost nothing further.

Each class is posted under the (coordinate, value) pairs of its signature, which
has ``COORDINATES`` coordinates; a coordinate's value is that of ``ROWS`` minima
of the set under different hashes together. Two sets of similarity s agree in a
coordinate with probability s^2, so unlike sets rarely share a list and lists
stay short as the corpus grows, while linked sets agree in 12.8 of 20 coordinates
on average and in fewer than ``T`` = 2 with probability below 5e-8. Two signatures
that agree in ``T`` coordinates share one of the first ``COORDINATES - T + 1`` of
them in any common order; so only this prefix is posted, rarest pairs first.
Rarity comes from counts over all documents in ``CELLS`` cells, a table of fixed
size that is exact enough to keep the commonest values out of the prefix. A pair
is retained if ``AGREE`` of the ``K`` single minima agree; linked sets agree in
fewer with probability below 1e-8.

Collisions are counted in two steps, neither of which makes all pairs of a
posting list. (1) Every list names a hub and each member meets only the hubs of
its lists; matches are counted over the signatures, pairs at or above the
threshold are confirmed on the full sets, and links are closed to components.
(2) What the hubs have joined is skipped: in each list only members outside the
hub's component are merged with the list: components must differ, sizes allow the
similarity, signatures match and bitmaps of the sets allow the similarity, all
within the join. What is confirmed joins components. Every link thus lies within
a component.

Texts are read once for the signatures and then only of documents that are in a
candidate pair: ids are marked in a table of fixed size, and the texts of marked
ids alone are joined to the pairs. Texts are shuffled instead of sets, which are
larger and don't compress; the sets are made again where a pair is confirmed.

Defined results: null texts and texts without words have empty sets and are
linked with nothing; a text of fewer than ``words`` words is one shingle; rows
that share a doc_id are one document with several sets; rows without doc_id are
linked with nothing and have no component (and are kept); extra columns are
ignored; empty tables give empty results. Texts are never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from factloom.llm.common import Marks, arrow_map, column_of, discard, materialize, runs_by_bytes, unused

#: Coordinates of a signature, minima of a coordinate, coordinates that must agree, minima that must.
COORDINATES, ROWS, T, AGREE = 20, 2, 2, 16
K = COORDINATES * ROWS
#: Cells of the counts, families of hubs.
CELLS, FAMILIES = 1 << 16, 8
#: Two sets are linked if 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80
#: Bits of the bitmaps that are compared before sets are.
BITS = 2048
#: Words of a shingle unless a caller says otherwise.
WORDS = 5
#: Seven minima of seven bits make up a packed number; lanes that are left over always agree.
PACKED = tuple(f"p{i}" for i in range(-(-K // 7)))
SPARE = 7 * len(PACKED) - K
#: Bytes of text that are worked on together; words whose hashes a worker remembers.
BLOCK_BYTES, REMEMBERED = 1 << 20, 1 << 16

_RANDOM = np.random.default_rng(20240229)
_MULTIPLIERS = _RANDOM.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; words are runs without ASCII white space, A-Z folded."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(h))
    out = h[: len(h) - size + 1] + np.uint64(size)
    for i in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * _STEP + h[i : len(h) - size + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of non-empty sets under ``K`` hashes, one row for each set."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), K), np.uint64)
    for c in range(K):
        out[:, c] = np.minimum.reduceat(joined * _MULTIPLIERS[c], starts)
    out ^= out >> np.uint64(31)
    return (out + np.arange(1, K + 1, dtype=np.uint64)[None, :] * _STEP) * _MIX


def _keys(minima: np.ndarray) -> np.ndarray:
    """Keys of the (coordinate, value) pairs; a coordinate's number is in each of its minima already."""
    parts = minima.reshape(len(minima), COORDINATES, ROWS)
    key = parts[:, :, 0].copy()
    for r in range(1, ROWS):
        key = ((key ^ (key >> np.uint64(29))) * _STEP) ^ parts[:, :, r]
    return (key ^ (key >> np.uint64(32))) * _MIX


def _packed(minima: np.ndarray) -> np.ndarray:
    lanes = np.zeros((len(minima), 7 * len(PACKED)), np.int64)
    lanes[:, :K] = ((minima >> np.uint64(33)) & np.uint64(0x7F)).astype(np.int64)
    return (lanes.reshape(len(minima), len(PACKED), 7) << (8 * np.arange(7))[None, None, :]).sum(2)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, h1, h2, keys, p0..``: size, digest and signature of every document's set."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        n = np.zeros(len(texts), np.int64)
        digests = np.zeros((len(texts), 2), np.int64)
        keys = np.zeros((len(texts), COORDINATES), np.uint64)
        packed = np.zeros((len(texts), len(PACKED)), np.int64)
        for a, z in runs_by_bytes([len(t or b"") for t in texts], BLOCK_BYTES):
            sets = [shingles(t, words) for t in texts[a:z]]
            n[a:z] = [len(s) for s in sets]
            digests[a:z] = [np.frombuffer(xxhash.xxh128_digest(s.tobytes()), ">i8") for s in sets]
            full = np.flatnonzero(n[a:z])
            if full.size:
                minima = _minima([sets[i] for i in full])
                keys[a + full], packed[a + full] = _keys(minima), _packed(minima)
        empty = n == 0
        offsets = np.arange(0, COORDINATES * len(texts) + 1, COORDINATES, dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array(n),
                pa.array(digests[:, 0], mask=empty),
                pa.array(digests[:, 1], mask=empty),
                pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64))),
                *(pa.array(np.ascontiguousarray(packed[:, i])) for i in range(len(PACKED))),
            ],
            names=["doc_id", "n", "h1", "h2", "keys", *PACKED],
        )

    return arrow_map(
        docs, batch, "doc_id long, n long, h1 long, h2 long, keys array<long>, " + ", ".join(f"{p} long" for p in PACKED)
    )


def _matches(a: str, b: str) -> Column:
    """Minima whose seven bits agree: zero lanes of the packed numbers' difference."""
    high = F.lit(0x80808080808080)
    total = F.lit(-SPARE)
    for p in PACKED:
        total = total + F.bit_count((high - F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))).bitwiseAND(high))
    return total


def _sizes_allow(a: str, b: str) -> Column:
    return (100 * F.col(f"{a}.n") >= SIMILARITY * F.col(f"{b}.n")) & (100 * F.col(f"{b}.n") >= SIMILARITY * F.col(f"{a}.n"))


def prefixes(reps: DataFrame) -> DataFrame:
    """``rep, prefix``: the (coordinate, value) pairs under which each class is posted, the rarest of its signature."""
    counted = (
        reps.select(F.explode("keys").alias("key"))
        .groupBy(F.shiftrightunsigned("key", 48).cast("int").alias("cell"))
        .count()
        .toArrow()  # at most CELLS rows, whatever the input
    )
    rarity = np.zeros(CELLS, np.int64)
    rarity[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    held = reps.sparkSession.sparkContext.broadcast(rarity)
    prefix = COORDINATES - T + 1

    def post(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, COORDINATES)
        by_key = np.sort(keys, axis=1)
        order = np.argsort(held.value[(by_key >> np.uint64(48)).astype(np.int64)], axis=1, kind="stable")[:, :prefix]
        chosen = np.ascontiguousarray(np.take_along_axis(by_key, order, 1)).view(np.int64).ravel()
        offsets = np.arange(0, len(chosen) + 1, prefix, dtype=np.int32)
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(chosen))], names=["rep", "prefix"])

    return arrow_map(reps.select("rep", "keys"), post, "rep long, prefix array<long>")


def _bitmaps(docs: DataFrame, words: int) -> DataFrame:
    """``rep, bits``: the sets as bitmaps of ``BITS`` bits."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        maps = []
        for text in b.column(1).to_pylist():
            s = shingles(text, words)
            flags = np.zeros(BITS, np.uint8)
            flags[((s >> np.uint64(40)) % np.uint64(BITS)).astype(np.int64)] = 1
            maps.append(np.packbits(flags).view(np.int64))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.list_(pa.int64()))], names=["rep", "bits"])

    return arrow_map(docs, batch, "rep long, bits array<long>")


def confirm(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough; sets are made anew from the texts of these alone."""
    marks = Marks(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), "doc_id")
    found = materialize(marks.keep(docs, F.col("doc_id")), "texts")
    marks.drop()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(b.num_rows, bool)
        last, of_last = None, None
        for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            if y != last:  # rows come by b, so its set serves several
                last, of_last = y, shingles(y, words)
            one = shingles(x, words)
            if not len(one) or not len(of_last):
                continue
            spot = np.minimum(np.searchsorted(of_last, one), len(of_last) - 1)
            common = int(np.count_nonzero(of_last[spot] == one))
            keep[i] = 100 * common >= SIMILARITY * (len(one) + len(of_last) - common)
        kept = b.filter(pa.array(keep))
        return pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])

    both = pairs.join(found.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(
        found.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b"
    )
    links = materialize(arrow_map(both.select("a", "b", "ta", "tb"), batch, "a long, b long"), "links")
    discard(found)
    return links


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of the nodes of ``a, b`` edges, written.

    Alternating large-star and small-star steps; each writes its edges, so an
    iteration's lineage is one step long. Edges stay as many as they are. The least
    neighbours are written before they are joined: a few are broadcast (Spark checks
    their size), many are shuffled like the edges, and adaptive execution can then
    split the edges of a centre, however many they are, over tasks.
    """
    edges = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        discard(low)
        discard(edges)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = materialize(small, "edges")
        discard(low)
        discard(large)
        row = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        now = (row["n"], row["s"])
        edges = after
        if now == state or not now[0]:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
            nodes = materialize(nodes, "components")
            discard(edges)
            return nodes
        state = now


def cluster(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = materialize(signatures(texts, words), "signatures")
    named = signed.where("n > 0 and doc_id is not null")
    classes = materialize(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = materialize(
        named.join(classes, ["h1", "h2"]).where("doc_id = rep").select("rep", "n", "keys", *PACKED), "representatives"
    )
    prefix = materialize(prefixes(reps), "prefixes")
    posted = prefix.select(F.explode("prefix").alias("key"), "rep")

    # (1) each list's hub: the least id after flipping bits in a way of the list's family
    flip = F.xxhash64(F.pmod("key", F.lit(FAMILIES)))
    hubs = (
        posted.select("key", F.col("rep").bitwiseXOR(flip).alias("r"))
        .groupBy("key")
        .agg(F.min("r").alias("r"), F.count("*").alias("m"))
        .where("m > 1")
        .select("key", F.col("r").bitwiseXOR(flip).alias("hub"))
    )
    lists = materialize(posted.join(hubs, "key"), "lists")
    small = reps.select("rep", "n", *PACKED)

    def filtered(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(small.alias("x"), F.col("a") == F.col("x.rep"))
            .join(small.alias("y"), F.col("b") == F.col("y.rep"))
            .where(_sizes_allow("x", "y") & (_matches("x", "y") >= AGREE))
            .select("a", "b")
        )

    met = lists.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    candidates = materialize(filtered(met), "candidates")
    links = confirm(candidates, texts, words)
    joined = components(links)
    discard(candidates)
    discard(links)

    # (2) members outside the hub's component, merged with their lists
    placed = small.join(joined, F.col("rep") == F.col("node"), "left").select(
        "rep", "n", *PACKED, F.coalesce("component", "rep").alias("component")
    )
    placed = materialize(placed, "placed")
    discard(reps)
    full = lists.join(placed, "rep").join(
        placed.select(F.col("rep").alias("hub"), F.col("component").alias("of_hub")), "hub"
    )
    full = materialize(full, "members")
    discard(lists)
    discard(placed)
    columns = ("key", "rep", "n", *PACKED, "component", "hub")
    outside = full.where("component <> of_hub").select(*columns)
    meets = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.col("y.rep") != F.col("x.hub"))
        & _sizes_allow("x", "y")
        & (_matches("x", "y") >= AGREE)
    )
    # who meets anyone at all: a row stays a row, however many it meets
    left = materialize(outside.alias("x").join(full.select(*columns).alias("y"), meets, "left_semi"), "outside")
    right = materialize(full.select(*columns).alias("y").join(left.alias("x"), meets, "left_semi"), "inside")
    discard(full)
    if not left.isEmpty():
        ids = left.select("rep").union(right.select("rep")).distinct().withColumnRenamed("rep", "doc_id")
        marks = Marks(ids, "doc_id")
        near_texts = marks.keep(texts, F.col("doc_id")).join(ids, "doc_id", "left_semi")
        sets = materialize(_bitmaps(near_texts, words).join(prefix, "rep"), "sets")
        marks.drop()
        # Bitmaps are compared inside the join, so that it puts out few pairs that aren't similar: bits that differ
        # are at most as many as shingles that do. Full sets confirm.
        # (a fold, since the unrolled sum of all words is more code than the JVM compiles)
        differ = F.aggregate(
            F.zip_with("x.bits", "y.bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, n: total + n
        )
        near = (100 + SIMILARITY) * differ <= (100 - SIMILARITY) * (F.col("x.n") + F.col("y.n"))
        # of the lists that two members share, one compares them
        once = F.array_min(F.array_intersect("x.prefix", "y.prefix")) == F.col("x.key")
        rest = (
            left.join(sets, "rep").alias("x").join(right.join(sets, "rep").alias("y"), meets & near & once)
            .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
            .distinct()
        )
        rest = materialize(rest, "candidates")
        discard(sets)
        more = confirm(rest, texts, words)
        discard(rest)
        if not more.isEmpty():
            first = joined
            joined = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
            discard(first)
        discard(more)
    for done in (left, right, prefix):
        discard(done)

    whole = classes.join(joined, F.col("rep") == F.col("node"), "left").select(
        "h1", "h2", F.coalesce("component", "rep").alias("component")
    )
    return signed.join(whole, ["h1", "h2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def remove(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group; all columns stay as they are, whatever their names.

    Of rows that share a kept doc_id and have the same set of shingles one stays; rows
    of unlike sets stay, as do those without doc_id or without words. Only rows whose
    ids are marked as gone or repeated are joined with these; the others pass without
    a shuffle.
    """
    found = materialize(cluster(docs, words, id_col, text_col), "groups")
    name, own = unused("gone", docs), column_of(id_col).cast("long")
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    marks = Marks(gone, name)
    kept = marks.leave(docs, own).unionByName(marks.keep(docs, own).join(gone, own == F.col(name), "left_anti"))
    repeated = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    repeated = materialize(repeated.select(F.col("doc_id").alias(name)), "repeated")
    discard(found)
    if repeated.isEmpty():
        return kept
    marks = Marks(repeated, name)
    again = marks.keep(kept, own)
    mark = unused("set_digest", docs)
    judged = _with_digest(again.join(repeated, own == F.col(name), "left_semi"), words, text_col, mark)
    once = judged.where(F.col(mark).isNotNull()).dropDuplicates([id_col, mark]).unionByName(judged.where(F.col(mark).isNull()))
    rest = again.join(repeated, own == F.col(name), "left_anti")
    return marks.leave(kept, own).unionByName(rest).unionByName(once.drop(mark))


def _with_digest(rows: DataFrame, words: int, text_col: str, name: str) -> DataFrame:
    """``rows`` with the digest of each text's set in column ``name``; null without words."""
    place = rows.columns.index(text_col)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = (shingles(t, words) for t in b.column(place).cast(pa.binary()).to_pylist())
        digests = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.binary())], names=[*b.schema.names, name])

    return arrow_map(rows, batch, StructType([*rows.schema.fields, StructField(name, BinaryType())]))
