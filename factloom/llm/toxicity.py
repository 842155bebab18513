"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, their stems (first 4 and 5 bytes),
word pairs, and pairs with one word between them, hashed into ``DIM`` buckets.
Training is online FTRL-proximal with a learning rate per coordinate and L1 and
L2 terms, so most weights are exactly zero; what remains is a sparse vector of
at most ``DIM`` numbers, a fixed bound, that is broadcast and applied in one
pass over the documents.

The weights are fitted on at most ``MAX_TRAIN`` labelled documents (a bound of
the fit alone: those with the smallest hashes of their ids, then of their texts), in
one task; a text that an id repeats counts once, so the bound is one of rows. Rows
with ``crc32(doc_id as text) mod 3 = 1`` are never among them. Scoring covers
every whole text; labels, language, source and id are no inputs of a score.

Defined results: null and empty texts have no features and get the score of the
bias; a labelled id without a document, a null id and a null label are not
learned from; of several labels for an id the greatest counts; a repeated
document row is scored as itself; very long texts are scored whole; without any labelled row every score is 0.5;
a null id is not held out; extra columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import arrow_map, ascii_words, release

#: Hash buckets; also the bound of the weights that are broadcast.
DIM = 1 << 20
#: The most labelled documents that the weights are fitted on.
MAX_TRAIN = 8_000
#: A text is toxic from this score on.
THRESHOLD = 0.7
#: Words remembered with their hashes by a worker before it starts anew.
REMEMBERED = 1 << 16

ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 0.5, 4

_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(44)


class Hasher:
    """Feature buckets of word lists; remembers the hashes of words it has met."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.table = np.empty((4096, 3), np.uint64)

    def _add(self, word: bytes) -> int:
        k = len(self.ids)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[k] = (
            xxhash.xxh64_intdigest(word),
            xxhash.xxh64_intdigest(word[:4], 4),
            xxhash.xxh64_intdigest(word[:5], 5),
        )
        self.ids[word] = k
        return k

    def features(self, words: list[bytes]) -> np.ndarray:
        """Buckets of all words, stems, pairs and skip pairs, with repeats."""
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        ids, add = self.ids, self._add
        k = np.array([ids[w] if w in ids else add(w) for w in words], np.int64)
        parts = self.table[k]
        word = parts[:, 0]
        mixed = np.concatenate(
            [parts.ravel(), word[:-1] * _PAIR + word[1:], (word[:-2] * _SKIP + word[2:]) ^ _SKIP]
        )
        return ((mixed * _MIX) >> _SHIFT).astype(np.int64)


class Weights:
    """A sparse linear model; zero weights are not kept."""

    def __init__(self, index: np.ndarray, value: np.ndarray, bias: float) -> None:
        self.index, self.value, self.bias = index, value, bias
        self.dense: np.ndarray | None = None

    def score(self, buckets: np.ndarray) -> float:
        if self.dense is None:
            self.dense = np.zeros(DIM)
            self.dense[self.index] = self.value
        known = np.unique(buckets[self.dense[buckets] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.dense[known].sum(), -35, 35))))

    def __getstate__(self) -> dict:
        return {"index": self.index, "value": self.value, "bias": self.bias, "dense": None}


def fit(rows: list[tuple[np.ndarray, int]]) -> Weights:
    """FTRL-proximal over (distinct buckets, label) rows in their order, ``EPOCHS`` times."""
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)  # the last coordinate is the bias

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zs) > L1, w, 0.0)

    def bias() -> float:
        return float(-z[DIM] / ((BETA + np.sqrt(n[DIM])) / ALPHA))

    for _ in range(EPOCHS):
        for at, label in rows:
            w = weights(at)
            b = bias()
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - label
            for where, old in ((at, w), (DIM, b)):
                grown = n[where] + g * g
                z[where] += g - (np.sqrt(grown) - np.sqrt(n[where])) / ALPHA * old
                n[where] = grown
    every = np.arange(DIM)
    w = weights(every)
    index = np.flatnonzero(w)
    return Weights(index, w[index], bias())


def held_out(id_col: str) -> Column:
    """Whether a row's label must not be learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Weights from a bounded sample of the rows that may be learned from."""
    chosen = (
        labels.select(F.col(id_col).alias("i"), F.col("toxic").cast("int").alias("y"))
        .where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out("i"))
        .groupBy("i")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("i"), "i")
        .limit(MAX_TRAIN)
    )
    # at most MAX_TRAIN rows of numbers: both broadcasts are bounded whatever the tables' size
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t"))
    rows = texts.join(F.broadcast(chosen), "i").withColumn("h", F.xxhash64("t"))
    first = rows.select("i", "h").distinct().orderBy(F.xxhash64("i"), "i", "h").limit(MAX_TRAIN)
    rows = rows.join(F.broadcast(first), ["i", "h"]).dropDuplicates(["i", "h"])
    hasher: list[Hasher] = []

    def featurize(b: pa.RecordBatch) -> pa.RecordBatch:
        if not hasher:
            hasher.append(Hasher())
        found = [np.unique(hasher[0].features(ascii_words(t))).astype(np.int32) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(found, pa.list_(pa.int32()))], names=["i", "y", "f"]
        )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (zlib.crc32(str(i).encode()), i, xxhash.xxh64_intdigest(f.tobytes()), f.copy(), y)
            for b in batches
            for i, y, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _lists(b.column(2)), strict=True)
        ]
        rows.sort(key=lambda r: r[:3])
        w = fit([(f, y) for *_, f, y in rows]) if rows else Weights(np.empty(0, np.int64), np.empty(0), 0.0)
        rows.clear()
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.index]), pa.array([w.value]), pa.array([w.bias])], names=["index", "value", "bias"]
        )
        release()

    features = arrow_map(rows.select("i", "t", "y"), featurize, f"i {dict(rows.dtypes)['i']}, y int, f array<int>")
    (row,) = (
        features.repartition(1).mapInArrow(learn, "index array<long>, value array<double>, bias double").collect()
        or [None]
    )
    if row is None:
        return Weights(np.empty(0, np.int64), np.empty(0), 0.0)
    return Weights(np.array(row["index"], np.int64), np.array(row["value"]), row["bias"])


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _scorer(spark, weights: Weights):
    held = spark.sparkContext.broadcast(weights)
    hasher: list[Hasher] = []

    def scores(texts: list[bytes | None]) -> list[float]:
        if not hasher:
            hasher.append(Hasher())
        return [held.value.score(hasher[0].features(ascii_words(t))) for t in texts]

    return scores


def score(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score and verdict of every document row."""
    scores = _scorer(docs.sparkSession, weights)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = scores(b.column(1).to_pylist())
        out = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in b.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array(out),
                pa.array(found, pa.float64()),
                pa.array([int(s >= THRESHOLD) for s in found], pa.int32()),
            ],
            names=["doc_id", "held_out", "score", "predicted"],
        )

    return arrow_map(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")),
        batch,
        "doc_id long, held_out boolean, score double, predicted int",
    )


def remove(docs: DataFrame, weights: Weights, text_col: str = "text") -> DataFrame:
    """``docs`` without the toxic rows; all columns stay as they are."""
    scores = _scorer(docs.sparkSession, weights)
    place = docs.columns.index(text_col)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = scores(b.column(place).cast(pa.binary()).to_pylist())
        return b.filter(pa.array([s < THRESHOLD for s in found], pa.bool_()))

    return arrow_map(docs, batch, docs.schema)
