"""Benchmark decontamination with suffix arrays over the training documents.

Documents are taken in shards of bounded bytes. A shard's words become numbers
(those of no benchmark word become 0) and its suffixes are sorted by their first
``WINDOW`` words into a suffix array, which holds only suffixes that can begin a
match: those that start with two words adjacent in some benchmark item, or with
the word of a one-word item. Every distinct test suffix is binary-searched once in
the shard's array, however many items have it; the range it finds has the places
of its occurrences. A place has at most one occurrence of each length, so a
shard's hits are bounded by ``WINDOW`` times its words. Words are marked as hit,
which joins occurrences that follow each other to the longest verbatim matches;
items are kept apart, as the windows that a document has and the items of these.

Documents never cross shards, so a document's hits are complete where they are
found and nothing is shuffled. The benchmark is read in blocks of at most
``BLOCK_WORDS`` words; if there are several, each is a broadcast of bounded size
and a pass of its own, and the documents' hit ranges meet by document.

Defined results: null and empty texts, and texts without words, have no words
and no hits and are clean; very long texts are a shard of their own and never cut;
a repeated document row is judged as itself; items that repeat count once per
item_id; the words of an item without id are hit like any other's, but it has no
name to be counted or listed; benchmark rows with null text are ignored; extra
columns are ignored, whatever their names; empty tables give empty or clean
results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from factloom.llm.common import arrow_map, ascii_words, materialize, runs_by_bytes, unused

#: Words of a window.
WINDOW = 13
#: Bytes of text whose suffixes are sorted together.
SHARD_BYTES = 4 << 20
#: Words of the benchmark that are held and broadcast at a time (some 10 MB of arrays and strings).
BLOCK_WORDS = 1 << 20


class TestSuffixes:
    """The distinct test suffixes of a block of items: keys to search, and which may begin a match.

    Items of the same words are one class; ``classes`` has the classes of each window
    and ``ids`` the names of each class.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]]) -> None:
        self.words: dict[bytes, int] = {}
        named: dict[tuple[bytes, ...], set[str]] = {}
        for item, words in items:
            named.setdefault(tuple(words), set()).update([] if item is None else [str(item)])
        self.ids = list(named.values())
        found: dict[tuple[int, ...], list[int]] = {}
        pairs, singles = set(), set()
        for k, words in enumerate(named):
            ns = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            n = min(WINDOW, len(ns))
            for window in {tuple(ns[p : p + n]) for p in range(len(ns) - n + 1)}:
                found.setdefault(window, []).append(k)
            pairs.update(zip(ns, ns[1:], strict=False))
            if len(ns) == 1:
                singles.add(ns[0])
        self.classes = list(found.values())
        self.length = np.array([len(w) for w in found], np.int64)
        keys = np.array([w + (0,) * (WINDOW - len(w)) for w in found], dtype=">u4").reshape(-1, WINDOW)
        self.low = _as_keys(keys)
        self.high = _as_keys(np.where(np.arange(WINDOW)[None, :] < self.length[:, None], keys, 0xFFFFFFFF).astype(">u4"))
        self.single = np.zeros(len(self.words) + 1, bool)
        self.single[np.array(sorted(singles), np.int64)] = True
        base = len(self.words) + 1
        self.pairs = np.unique(np.array([a * base + b for a, b in pairs], dtype=np.int64))

    def names(self, windows: frozenset[int]) -> set[str]:
        """The items of windows."""
        return set().union(*(self.ids[c] for c in {c for w in windows for c in self.classes[w]}))


def _as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which compare as the rows do."""
    return np.ascontiguousarray(rows).view(f"S{4 * WINDOW}").ravel()


def search_shard(texts: list[list[bytes]], tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: where each text starts, which words are hit, and its distinct (text, window) pairs.

    Texts lie ``WINDOW`` words apart, so that no suffix runs into the next one.
    """
    get = tests.words.get
    flat: list[int] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for i, words in enumerate(texts):
        flat += [get(w, 0) for w in words]
        flat += [0] * WINDOW
        starts[i + 1] = len(flat)
    ids = np.array(flat, np.int64)
    change, pairs = np.zeros(len(ids) + 1, np.int32), [np.empty((0, 2), np.int64)]
    for where, window in _occurrences(ids, tests):
        np.add.at(change, where, 1)
        np.add.at(change, where + tests.length[window], -1)
        text = np.searchsorted(starts, where, side="right") - 1
        once = np.unique(text * len(tests.length) + window)
        pairs.append(np.stack([once // len(tests.length), once % len(tests.length)], 1))
    return starts, np.cumsum(change[:-1]) > 0, np.concatenate(pairs)


def _occurrences(ids: np.ndarray, tests: TestSuffixes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and windows of all occurrences, a length of windows at a time: at most one for each place."""
    if not ids.size or not tests.length.size:
        return
    base = len(tests.words) + 1
    live = np.flatnonzero((ids[:-1] > 0) & ((ids[1:] > 0) | tests.single[ids[:-1]]))
    may = tests.single[ids[live]]
    if tests.pairs.size:
        pair = ids[live] * base + ids[live + 1]
        spot = np.minimum(np.searchsorted(tests.pairs, pair), tests.pairs.size - 1)
        may |= tests.pairs[spot] == pair
    live = live[may]
    if not live.size:
        return
    suffixes = _as_keys(np.concatenate([ids, np.zeros(WINDOW, np.int64)])[live[:, None] + np.arange(WINDOW)].astype(">u4"))
    order = np.argsort(suffixes, kind="stable")
    array = suffixes[order]
    first = np.searchsorted(array, tests.low, side="left")
    counts = np.searchsorted(array, tests.high, side="right") - first
    for n in np.unique(tests.length[counts > 0]):
        hit = np.flatnonzero((counts > 0) & (tests.length == n))
        many = counts[hit]
        at = np.repeat(first[hit] - np.cumsum(many) + many, many) + np.arange(many.sum())
        yield live[order[at]], np.repeat(hit, many)


def covered(ranges: list[tuple[int, int]]) -> int:
    """Words in the union of (first, end) ranges."""
    total = end = 0
    for a, b in sorted(ranges):
        if b > end:
            total += b - max(a, end)
            end = b
    return total


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[TestSuffixes]:
    """The benchmark in blocks of bounded size, one at a time.

    An item longer than a block comes in pieces that overlap by all but one word of
    a window, so that each of its windows is in one of them.
    """
    block: list[tuple[object, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    for row in rows.orderBy("i", "t").toLocalIterator():
        words = ascii_words(row["t"].encode("utf-8", "surrogatepass"))
        for at in range(0, max(1, len(words) - WINDOW + 1) if words else 0, BLOCK_WORDS):
            piece = words[at : at + BLOCK_WORDS + WINDOW - 1]
            if block and size + len(piece) > BLOCK_WORDS:
                yield TestSuffixes(block)
                block, size = [], 0
            block.append((row["i"], piece))
            size += len(piece)
    if block:
        yield TestSuffixes(block)


def _matches(texts: list[bytes | None], tests: TestSuffixes) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text: its number of words, the ranges of words that match, the items."""
    out = []
    for a, b in runs_by_bytes([len(t or b"") for t in texts], SHARD_BYTES):
        shard = [ascii_words(t) for t in texts[a:b]]
        starts, hit, pairs = search_shard(shard, tests)
        edges = np.flatnonzero(np.diff(hit, prepend=False, append=False)).reshape(-1, 2)
        of = np.searchsorted(starts, edges[:, 0], side="right") - 1
        ranges: list[list[tuple[int, int]]] = [[] for _ in shard]
        for k, (first, end) in zip(of.tolist(), (edges - starts[of][:, None]).tolist(), strict=True):
            ranges[k].append((first, end))
        windows: list[list[int]] = [[] for _ in shard]
        for k, w in pairs.tolist():
            windows[k].append(w)
        known: dict[frozenset[int], set[str]] = {}  # texts with the same passages have the same items
        for words, own, seen in zip(shard, ranges, windows, strict=True):
            key = frozenset(seen)
            if key not in known:
                known[key] = tests.names(key)
            out.append((len(words), own, known[key]))
    return out


def _verdict(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Between passes over several blocks of items a row carries what the earlier ones found.
_FOUND = (("found_ranges", ArrayType(LongType())), ("found_items", ArrayType(StringType())))
#: Passes in a row before the rows are written, so that few workers hold blocks at once.
PASSES = 4


def _pass(df: DataFrame, place: int, tests: TestSuffixes, carried: bool, finish, schema: str | None, names: list[str]) -> DataFrame:
    """One pass over the documents for one block of items; ``finish`` makes a batch of the matches."""
    held = df.sparkSession.sparkContext.broadcast(tests)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = _matches(b.column(place).cast(pa.binary()).to_pylist(), held.value)
        if carried:
            before = zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)
            found = [
                (n, r + list(zip(old[::2], old[1::2], strict=True)), i | set(names))
                for (n, r, i), (old, names) in zip(found, before, strict=True)
            ]
        return finish(b, found)

    fields = df.schema.fields[:-2] if carried else df.schema.fields
    if schema is None:  # a pass between
        out = StructType(list(fields))
        for name, (_, kind) in zip(names, _FOUND, strict=True):
            out = out.add(name, kind)
        return arrow_map(df, batch, out)
    return arrow_map(df, batch, schema)


def _between(width: int, added: list[str]):
    def finish(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
        flat = [[x for pair in r for x in pair] for _, r, _ in found]
        names = [sorted(i) for _, _, i in found]
        return pa.RecordBatch.from_arrays(
            [*b.columns[:width], pa.array(flat, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))],
            names=[*b.schema.names[:width], *added],
        )

    return finish


def _over_blocks(df: DataFrame, place: int, benchmark: DataFrame, finish, schema) -> DataFrame:
    """All passes; the last makes the result. Blocks of items are never held together."""
    width, done, ahead = len(df.columns), 0, None
    names = [unused(n, df) for n, _ in _FOUND]
    for tests in item_blocks(benchmark):
        if ahead is not None:
            df = _pass(df, place, ahead, done > 0, _between(width, names), None, names)
            done += 1
            if done % PASSES == 0:
                df = materialize(df, "decontaminate")
        ahead = tests
    return _pass(df, place, ahead or TestSuffixes([]), done > 0, finish, schema, names)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: words, words inside occurrences, items and the verdict."""

    def finish(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
        hits = [covered(r) for _, r, _ in found]
        names = [",".join(sorted(i)) for _, _, i in found]
        return pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array(hits, pa.int64()),
                pa.array([len(i) for _, _, i in found], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names]),
                pa.array([_verdict(n, h) for (n, _, _), h in zip(found, hits, strict=True)]),
            ],
            names=[x.split()[0] for x in RESULT.split(", ")],
        )

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _over_blocks(docs, 1, benchmark, finish, RESULT)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The merged ranges of a document's words that occur in the benchmark: one row per range."""

    def finish(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
        ids, first, end = [], [], []
        for i, (_, ranges, _) in zip(b.column(0).to_pylist(), found, strict=True):
            at = -1
            for a, z in sorted(ranges):
                if a > at:
                    ids.append(i)
                    first.append(a)
                    end.append(z)
                else:
                    end[-1] = max(end[-1], z)
                at = max(at, z)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, first, end)], names=["doc_id", "first_word", "end_word"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _over_blocks(docs, 1, benchmark, finish, "doc_id long, first_word long, end_word long")


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows; all columns stay as they are."""

    def finish(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
        keep = [not _verdict(n, covered(r)) for n, r, _ in found]
        kept = b.filter(pa.array(keep, pa.bool_()))
        return pa.RecordBatch.from_arrays(kept.columns[:width], schema=pa.schema(list(b.schema)[:width]))

    width = len(docs.columns)
    return _over_blocks(docs, docs.columns.index(text_col), benchmark, finish, docs.schema)
