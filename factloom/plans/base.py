"""Registration of queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


#: Rows of a task where each costs much more to work on than to read.
TASK_ROWS = 10_000


def spread(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` in partitions of about ``rows`` rows by ``key``: rows that pack small would be the work of few tasks."""
    n = -(-df.count() // rows)
    return df if n <= 1 else df.repartition(n, key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
