"""Filter interaction audit: what each filter removes in every order of the filters.

One pass over the texts gives every document the set of filters that it fails, five
bits, and a digest of its text; texts aren't shuffled. A text that a smaller id has
too is found by the digests: the least id of each digest that occurs more than
once is written and joined back, so that adaptive execution can split a text that a
third of all documents share.

Documents that have the part, the failures and the labels in common are counted
before anything else, at most 128 rows a part, whatever its size. ``mapInArrow``
then looks the failures up in a table of 32 sets by 120 orders that says at which
step a document goes (or that it stays); ``np.bincount`` adds the counts up by part,
order and step, for all documents and for those of each label, and Spark sums the
partial arrays, a row for each part, order and step.

Defined results: a null text is empty, and an empty one fails the filter on short
texts alone, and that on repeats if a smaller id is empty too; a null part is the
empty string; a row without id counts but is never a repeat and makes none; rows
that repeat an id and its text aren't repeats of each other; several labels of an
id count if one of them is 1, a null id or label counts for nothing; extra columns
are ignored, and an empty table gives an empty result. Texts are read whole,
however long. Equal texts are those of equal SHA-256.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import arrow_map, column_of, discard, materialize, release

FILTERS = "ABCDE"
ORDERS = ["".join(x) for x in permutations(FILTERS)]
#: Fixed values of the conditions.
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
_NOT_UPPER, _CONTINUED = bytes(c for c in range(256) if not 65 <= c <= 90), bytes(range(0x80, 0xC0))
_MARKS = re.compile(rb"[#$%&*|]")
#: Parts whose arrays a task holds at once (some 17 KB each).
PARTS = 256


def failure_table() -> np.ndarray:
    """[failed filters as bits, order]: the step (from 0) at which a document goes, 5 if it stays."""
    table = np.full((1 << len(FILTERS), len(ORDERS)), len(FILTERS), np.int64)
    for k, order in enumerate(ORDERS):
        for step in reversed(range(len(FILTERS))):
            failed = (np.arange(len(table)) >> FILTERS.index(order[step])) & 1 == 1
            table[failed, k] = step
    return table


#: [order, step]: the number of the step's filter.
FILTER_AT = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])


def own_failures(text: bytes) -> int:
    """The bits of the filters that a text fails by itself (all but E)."""
    words = text.split()
    bits = (len(words) < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
    upper, points = len(text.translate(None, _NOT_UPPER)), len(text.translate(None, _CONTINUED))
    return bits | (100 * upper > UPPER_PERCENT * points) << 2 | (_MARKS.search(text) is not None) << 3


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, failed`` of every document row, ``failed`` with a bit for each filter."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pc.fill_null(b.column(1), ""),
                pa.array([own_failures(t) for t in texts], pa.int32()),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            ],
            names=["doc_id", "part", "failed", "digest"],
        )

    rows = docs.select(
        column_of(id_col).cast("long").alias("doc_id"), column_of(part_col).cast("string").alias("part"), column_of(text_col).cast("binary").alias("text")
    )
    light = materialize(arrow_map(rows, batch, "doc_id long, part string, failed int, digest binary"), "failures")
    repeated = light.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    repeated = materialize(repeated.select("digest", "least"), "repeated")
    again = F.when(F.col("doc_id") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0)
    found = light.join(repeated, "digest", "left").select("doc_id", "part", (F.col("failed") + again).alias("failed"))
    found = materialize(found, "failed")
    discard(light)
    discard(repeated)
    return found


def label_flags(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, good, toxic`` of each labelled id, written, so that a join with it can be split."""
    one = lambda name: F.max(F.coalesce((column_of(name) == 1).cast("int"), F.lit(0)))
    rows = labels.where(column_of(id_col).isNotNull()).groupBy(column_of(id_col).cast("long").alias("doc_id"))
    return materialize(rows.agg(one("quality").alias("good"), one("toxic").alias("toxic")), "flags")


def _removals(b: pa.RecordBatch, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Partial arrays of a batch of ``part, failed, good, toxic, n`` rows: a row for each part, order and step."""
    parts = b.column(0).dictionary_encode()
    code, names = parts.indices.to_numpy(), parts.dictionary.to_pylist()
    failed, good, toxic, n = (b.column(i).to_numpy() for i in range(1, 5))
    orders, steps = table.shape[1], len(FILTERS)
    bits = 1 << np.arange(steps)
    for low in range(0, len(names), PARTS):
        some = np.flatnonzero((code >= low) & (code < low + PARTS))
        here = min(PARTS, len(names) - low)
        own, sets, count = code[some] - low, failed[some], n[some]
        cell = ((own[:, None] * orders + np.arange(orders)) * (steps + 1) + table[sets]).ravel()

        def by_step(weight: np.ndarray) -> np.ndarray:
            """[part, order, step] of those that go; sums stay below 2^53."""
            added = np.bincount(cell, np.repeat(weight, orders), here * orders * (steps + 1))  # noqa: B023
            return added.astype(np.int64).reshape(here, orders, steps + 1)[:, :, :steps]

        def by_filter(holds: np.ndarray) -> np.ndarray:
            """[part, order, step] of documents for which ``holds`` [row, filter], by the step's filter."""
            sums = np.stack([np.bincount(own, count * holds[:, f], here) for f in range(steps)], 1)  # noqa: B023
            return sums.astype(np.int64)[:, FILTER_AT]

        removed = by_step(count)
        fails = by_filter((sets[:, None] & bits) > 0)
        whole = np.bincount(own, count, here).astype(np.int64)
        shapley = np.stack([removed[:, FILTER_AT == f].sum(1) for f in range(steps)], 1)[:, FILTER_AT]
        columns = (
            whole[:, None, None] - removed.cumsum(2),
            removed,
            fails - removed,
            by_filter(sets[:, None] == bits),
            by_step(count * good[some]),
            by_step(count * toxic[some]),
            shapley,
        )
        for k in range(here):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[low + k]] * (orders * steps), pa.string()),
                    pa.array(np.repeat(np.arange(orders, dtype=np.int32), steps)),
                    pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), orders)),
                    *(pa.array(c[k].ravel()) for c in columns),
                ],
                names=["part", "order", "step", *COUNTS],
            )


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """``part, filter_order, step`` and the counts of each, zeros included."""
    known = label_flags(labels, id_col)
    found = failures(docs, id_col, text_col, part_col)
    flag = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    states = (
        found.join(known, "doc_id", "left")
        .select("part", "failed", flag("good"), flag("toxic"))
        .groupBy("part", "failed", "good", "toxic")
        .agg(F.count("*").alias("n"))
    )
    states = materialize(states, "states")
    discard(found)
    discard(known)
    held = docs.sparkSession.sparkContext.broadcast(failure_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from _removals(b, held.value)
        release()

    # a part's few rows come together, so that it has one array, or two where a batch ends
    together = states.repartition("part").sortWithinPartitions("part")
    partial = together.mapInArrow(run, "part string, order int, step int, " + ", ".join(f"{c} long" for c in COUNTS))
    name = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("order") + 1)
    return (
        partial.groupBy("part", "order", "step")
        .agg(*(F.sum(c).alias(c) for c in COUNTS))
        .select("part", name.alias("filter_order"), "step", *COUNTS)
    )
