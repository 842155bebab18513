"""Streaming forms: consecutive failures as keyed state, windowed counts with late data (H10, extensions)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT = 3


def breaker(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``key, opened_at``: emitted once when ``limit`` failures of a key follow each other.

    ``events`` is ``key string, seq long, failed boolean``; state is two numbers a key.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, opened = state.get if state.exists else (0, False)
        out = []
        for rows in frames:
            for seq, failed in rows.sort_values("seq")[["seq", "failed"]].itertuples(index=False):
                run = run + 1 if failed else 0
                if run >= limit and not opened:
                    opened = True
                    out.append((key[0], int(seq)))
        state.update((run, opened))
        yield pd.DataFrame(out, columns=["key", "opened_at"])

    return events.groupBy("key").applyInPandasWithState(
        step, "key string, opened_at long", "run int, opened boolean", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, ts: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and kind; rows later than the watermark are dropped."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", width).alias("w"), kind).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), kind, "n"
    )
