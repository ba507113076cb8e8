"""A per-task ring buffer as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "task_id long, seq long, type string"


class Ring(StatefulProcessor):
    """Keeps each task's last ``keep`` events; gives what the buffer holds after each batch.

    Events come in any order; a sequence number seen before is ignored. An event of type
    ``clear`` empties the task's buffer.
    """

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "seq long, type string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = {r[0]: r[1] for r in self.held.get()}
        for batch in rows:
            for seq, kind in sorted(zip(batch["seq"].tolist(), batch["type"].tolist(), strict=True)):
                if kind == "clear":
                    events = {}
                else:
                    events.setdefault(seq, kind)
        last = sorted(events.items())[-self.keep :]
        if last:
            self.held.put(last)
        else:
            self.held.clear()
        yield pd.DataFrame({"task_id": [key[0]] * len(last), "seq": [s for s, _ in last], "type": [k for _, k in last]})

    def close(self) -> None:
        pass


def ring(events: DataFrame, keep: int = 500) -> DataFrame:
    """Streaming ``task_id, seq, type`` to the buffers' contents; needs the RocksDB state store."""
    return events.groupBy("task_id").transformWithStateInPandas(Ring(keep), OUT, "Update", "None")
