"""Task statuses on a stream, as a keyed state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TYPES = ("created", "started", "completed", "failed", "cancelled")
OUT = "task_id long, status string, stale boolean"


def status_of(first: dict[str, int | None]) -> str:
    """The status that the first event of each type leads to: the first end stays, and only what
    hasn't started can be cancelled."""
    started, cancelled = first["started"], first["cancelled"]
    if cancelled is not None and (started is None or cancelled < started):
        return "cancelled"
    ends = sorted((first[t], t) for t in ("completed", "failed") if first[t] is not None)
    # of a tie, the failure stays
    return ("failed" if ends[-1] == (ends[0][0], "failed") else ends[0][1]) if ends else "running" if started is not None else "pending"


class Lifecycle(StatefulProcessor):
    """Keeps the first sequence number of each type of event a task has had.

    That is the same for any order, batching and repetition of the events, so statuses are those
    of ``events.statuses`` over all that came. A task that is pending or running and had no event
    for ``stale_ms`` is given again, as stale; an event makes it fresh.
    """

    def __init__(self, stale_ms: int | None):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", ", ".join(f"{t} long" for t in TYPES))

    def _held(self) -> dict[str, int | None]:
        return dict(zip(TYPES, self.first.get() if self.first.exists() else [None] * len(TYPES), strict=True))

    def _row(self, key, status: str, stale: bool) -> pd.DataFrame:
        return pd.DataFrame({"task_id": [key[0]], "status": [status], "stale": [stale]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, known = self._held(), False
        for batch in rows:
            for kind, seq in batch.loc[batch["type"].isin(TYPES)].groupby("type")["seq"].min().items():
                known = True
                first[kind] = int(seq) if first[kind] is None else min(first[kind], int(seq))
        if not known:
            return
        self.first.update(tuple(first.values()))
        status = status_of(first)
        if self.stale_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if status in ("pending", "running"):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stale_ms)
        yield self._row(key, status, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status = status_of(self._held())
        if status in ("pending", "running"):
            yield self._row(key, status, True)

    def close(self) -> None:
        pass


def statuses(events: DataFrame, stale_ms: int | None = None) -> DataFrame:
    """Streaming ``task_id, seq, type`` to ``task_id, status, stale`` of each task that had an event
    (or, with ``stale_ms``, none for so long); needs the RocksDB state store."""
    mode = "None" if stale_ms is None else "ProcessingTime"
    return events.groupBy("task_id").transformWithStateInPandas(Lifecycle(stale_ms), OUT, "Update", mode)
