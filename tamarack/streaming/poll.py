"""Looking at a stream at fixed times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

SECONDS = 4


def poll(events: DataFrame, show: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = SECONDS) -> StreamingQuery:
    """Start giving ``show`` what came since its last call, every ``seconds`` (None: once, with
    all that is there). ``checkpoint`` is a shared folder, from which a restart goes on."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return events.writeStream.foreachBatch(show).option("checkpointLocation", checkpoint).trigger(**trigger).start()
