"""Confirmed actions as a stream: one-shot nonces with a time to live, in event time.

The state of a nonce is what has come but lies behind no watermark yet, and the action
that waits. Timers fire once the watermark has passed a row, and rows are taken in
the order of their times then, so the outcomes are those of ``relations.dispatch``
whatever order rows come in within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType

from factloom.operators.relations import TIERS, TIME_TO_LIVE

RESULT = "id string, kind string, outcome string, partner string"
#: What the stream's state needs of the session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Confirmations(StatefulProcessor):
    """Requests and confirmations of one nonce."""

    def __init__(self, enabled: tuple[int, ...], seconds: int, numbered: bool = False) -> None:
        self.enabled, self.micros, self.numbered = enabled, seconds * 1_000_000, numbered

    def _order(self, row: tuple) -> tuple:
        """Time, confirmations first, then ids: as numbers if they are, as in a batch."""
        return row[0], row[1], int(row[2]) if self.numbered else row[2]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", "at long, kind int, id string, user string")
        self.waits = handle.getValueState("waits", "id string, user string, at long, by string, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, held = [], []
        for frame in rows:
            for at, kind, id_, user, tool in frame[["at", "kind", "id", "user", "tool"]].itertuples(index=False):
                tier = TIERS.get(tool) if kind else None
                if kind and tier not in self.enabled:
                    out.append((id_, "request", "unknown" if tier is None else "disabled", None))
                    continue
                held.append((int(at), int(kind), id_, user))
        if held:
            self.early.appendList(held)
            # one timer is enough: it takes all rows that the watermark has passed, and sets the next
            self.handle.registerTimer(min(r[0] for r in held) // 1000 + 1)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        early = [tuple(r) for r in self.early.get()]
        due = sorted((r for r in early if r[0] <= passed), key=self._order)
        if len(due) < len(early):
            later = [r for r in early if r[0] > passed]
            if due:
                self.early.put(later)
            self.handle.registerTimer(min(r[0] for r in later) // 1000 + 1)
        elif due:
            self.early.clear()
        waits = tuple(self.waits.get()) if self.waits.exists() else None
        out = []
        for at, kind, id_, user in due:  # of the same moment confirmations come first, so none is later
            if kind:
                out += _forgotten(waits)
                waits = (id_, user, at, None, False)
            elif waits is None:
                out.append((id_, "confirm", "none", None))
            else:
                asked, owner, since, by, told = waits
                if at - since > self.micros:
                    outcome = "expired"
                elif user != owner:
                    outcome = "other_user"
                elif by is None:
                    outcome = "executed"
                    out.append((asked, "request", "executed", id_))
                    waits = (asked, owner, since, id_, True)
                else:
                    outcome = "used"
                out.append((id_, "confirm", outcome, asked))
        if waits is not None and passed > waits[2] + self.micros:
            out += _forgotten(waits)
            waits = (*waits[:4], True)
        if waits is not None:
            self.waits.update(waits)
            if not waits[4]:  # the action that is left waiting alone needs a time to be forgotten
                self.handle.registerTimer((waits[2] + self.micros) // 1000 + 1)
        yield _frame(out)

    def close(self) -> None:
        pass


def _forgotten(waits: tuple | None) -> list[tuple]:
    """What is said of an action that wasn't confirmed, once."""
    return [(waits[0], "request", "unconfirmed", None)] if waits is not None and not waits[4] else []


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "kind", "outcome", "partner"], dtype="object")


def dispatch_stream(events: DataFrame, enabled: tuple[int, ...], late: str, seconds: int = TIME_TO_LIVE) -> DataFrame:
    """``id, kind, outcome, partner`` of a stream of requests and confirmations, as ``relations.dispatch`` has them.

    ``events`` is ``id, asks, user, tool, nonce, ts``; rows later than ``late`` are
    dropped. A nonce that is null serves nobody. The session needs ``STATE_STORE``.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    ts = F.col("ts").cast("timestamp")
    numbered = isinstance(events.schema["id"].dataType, IntegralType)
    timed = events.select(
        text("id"), F.col("asks").cast("int").alias("kind"), text("user"), text("tool"), text("nonce"), F.unix_micros(ts).alias("at"), ts.alias("time")
    ).withWatermark("time", late)
    return timed.groupBy("nonce").transformWithStateInPandas(Confirmations(enabled, seconds, numbered), RESULT, "append", "EventTime")
