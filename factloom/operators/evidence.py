"""Evidence of evaluations: digests of inputs, pairing of arms, drift, and where a packet may be written."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What makes up an item's identity, so that two arms are of the same rows.
IDENTITY = ("category", "tbl", "key", "question", "expected", "kind", "second_tbl", "second_key")


def canonical_json(value: object) -> bytes:
    """JSON with sorted keys and without blanks, in UTF-8."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def canonical_sha256(value: object) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def tree_digests(files: DataFrame, tree: str) -> DataFrame:
    """``tree, files, digest``: one digest over ``path, content`` of each tree: names and bytes in order of the names, each ended by a zero byte.

    A digest depends on the order of all that it covers, so a tree's files stream
    through one task, sorted; the task holds one file and the state of the digest.
    """
    kind = dict(files.dtypes)[tree]
    rows = files.select(tree, F.col("path").cast("binary").alias("path"), F.col("content").cast("binary").alias("content"))
    rows = rows.repartition(tree).sortWithinPartitions(tree, "path")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, digest = None, 0, None
        out: list[tuple[object, int, str]] = []
        for b in batches:
            for name, path, content in zip(*b.columns, strict=True):
                if digest is None or name != now:
                    if digest is not None:
                        out.append((now, n, digest.hexdigest()))
                    now, n, digest = name, 0, hashlib.sha256()
                digest.update(path.as_py() + b"\0" + (content.as_py() or b"") + b"\0")
                n += 1
        if digest is not None:
            out.append((now, n, digest.hexdigest()))
        if out:
            names, counts, digests = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in names], names[0].type), pa.array(counts, pa.int64()), pa.array(digests)], names=[tree, "files", "digest"])

    return rows.mapInArrow(fold, f"`{tree}` {kind}, files long, digest string")


def tree_sha256(files: DataFrame) -> str:
    """The digest of one tree, ``path, content``; the driver gets the digest alone."""
    row = tree_digests(files.withColumn("tree", F.lit(0)), "tree").first()
    return row["digest"] if row else hashlib.sha256().hexdigest()


def pairing(base: DataFrame, adapter: DataFrame, index: str, identity: list[str], seed: str, prompt: str) -> DataFrame:
    """Two arms by position: rows, and how many lack a partner, differ in identity or seed, or lack or differ in the first prompt.

    One row; the arms are a pair if all but ``rows`` are 0 and there are rows.
    """
    a, b = base.alias("a"), adapter.alias("b")
    both = a.join(b, F.col(f"a.{index}") == F.col(f"b.{index}"), "full_outer")
    paired = F.col(f"a.{index}").isNotNull() & F.col(f"b.{index}").isNotNull()
    same = F.lit(True)
    for f in identity:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    blank = F.coalesce(F.col(f"a.{prompt}"), F.lit("")) == ""
    return both.agg(
        F.count("*").alias("rows"),
        F.count_if(~paired).alias("unpaired"),
        F.count_if(paired & ~same).alias("identity"),
        F.count_if(paired & ~F.col(f"a.{seed}").eqNullSafe(F.col(f"b.{seed}"))).alias("seed"),
        F.count_if(paired & (blank | ~F.col(f"a.{prompt}").eqNullSafe(F.col(f"b.{prompt}")))).alias("prompt"),
    )


def check_pairing(base: DataFrame, adapter: DataFrame, index: str, identity: list[str], seed: str, prompt: str) -> int:
    """The number of rows of two arms that are a pair; an error says what they differ in."""
    found = pairing(base, adapter, index, identity, seed, prompt).first().asDict()
    rows = found.pop("rows")
    wrong = [k for k, n in found.items() if n]
    if wrong or not rows:
        raise ValueError(f"the arms are no pair: {', '.join(wrong) or 'no rows'}")
    return rows


def drifted(before: DataFrame, after: DataFrame) -> DataFrame:
    """``name, was, is``: bound inputs (``name, sha256``) whose digests changed, appeared or vanished during a run."""
    a, b = before.select("name", F.col("sha256").alias("was")), after.select("name", F.col("sha256").alias("is"))
    return a.join(b, "name", "full_outer").where(~F.col("was").eqNullSafe(F.col("is")))


def bind(inputs: dict[str, str | None], controls: dict[str, object]) -> dict[str, object]:
    """Metadata of a packet: the digests of its inputs and its controls, with a digest over both."""
    bound = {"inputs": dict(inputs), "controls": dict(controls)}
    return bound | {"binding_sha256": canonical_sha256(bound)}


def finalize(before: dict, after: dict) -> dict:
    """The metadata of a finished run; an error if an input changed while it went on."""
    changed = sorted(k for k in {*before["inputs"], *after["inputs"]} if before["inputs"].get(k) != after["inputs"].get(k))
    if changed:
        raise RuntimeError(f"inputs changed during the run: {', '.join(changed)}")
    return before | {"inputs_stable": True, "complete": all(before["inputs"].values())}


def refuse_aliases(target: str, inputs: dict[str, str | None]) -> None:
    """An error if a packet would be written onto or into one of its inputs (paths of the driver)."""
    place = os.path.realpath(target)
    for name, path in inputs.items():
        if not path:
            continue
        there = os.path.realpath(path)
        same = place == there or os.path.exists(place) and os.path.exists(there) and os.path.samefile(place, there)
        if same or os.path.isdir(there) and os.path.commonpath([place, there]) == there:
            raise ValueError(f"the packet must not be written onto or into {name}: {path}")
