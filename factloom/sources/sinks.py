"""Writers of tables, training lines, evidence and manifests."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Parquet for each table, overwritten; returns ``tbl, n`` read from what was written."""
    counts = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        one = df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}").select(F.lit(name).alias("tbl"))
        counts = one if counts is None else counts.union(one)
    return counts.groupBy("tbl").agg(F.count("*").alias("n"))


def admitted_lines(results: DataFrame) -> DataFrame:
    """``value``: JSON of admitted results with their samples; the method follows the lane."""
    method = F.when(F.col("lane") == "fact_seeded", "static_oracle").otherwise("adversarial_judge")
    return results.where("verification.success and sample is not null").select(
        F.to_json(
            F.struct(
                F.col("sample.instruction").alias("instruction"),
                F.col("sample.answer").alias("response"),
                F.struct(method.alias("method")).alias("verification"),
            )
        ).alias("value")
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Text lines; the commit makes the directory appear whole, also without rows."""
    lines.select("value").write.mode("overwrite").text(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """JSON lines in a directory for each ``split``."""
    columns = [c for c in rows.columns if c != "split"]
    rows.select("split", F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def write_evidence(document: dict, path: str) -> None:
    """One small document of the driver: written aside, synced and moved into place."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(document, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


#: Rows up to which a table is put into one document.
MOST_DOCUMENT_ROWS = 100_000


def dump_document(tables: dict[str, DataFrame]) -> DataFrame:
    """``tbl, rows``: each small table as one JSON array; a table of more than ``MOST_DOCUMENT_ROWS`` is an error.

    Tables of any size go through ``write_dump``.
    """
    out = None
    for name, df in tables.items():
        if df.limit(MOST_DOCUMENT_ROWS + 1).count() > MOST_DOCUMENT_ROWS:
            raise ValueError(f"{name} is too large for one document")
        one = df.agg(F.lit(name).alias("tbl"), F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def write_dump(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Each table as JSON lines in a folder of its own (B6); returns ``tbl, n``."""
    counts = None
    for name, df in tables.items():
        lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
        lines.write.mode("overwrite").text(f"{root}/{name}")
        one = df.sparkSession.read.text(f"{root}/{name}").select(F.lit(name).alias("tbl"))
        counts = one if counts is None else counts.union(one)
    return counts.groupBy("tbl").agg(F.count("*").alias("n"))


def dump_summary(counts: DataFrame) -> DataFrame:
    """``summary``: the counts of a dump as one line (a row for each table)."""
    each = F.array_sort(F.collect_list(F.struct("tbl", "n")))
    return counts.agg(F.array_join(F.transform(each, lambda r: F.concat_ws("=", r["tbl"], r["n"])), ", ").alias("summary"))
