"""Task events: bounded buffers, cursors, feeds, status and metrics."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.sources.shared import delete, fresh_path

PER_TASK, TOTAL = 500, 10_000
#: Events that one task of the eviction's fold follows.
RANGE = 2_000_000
SLOTS = 5
#: Event types that end or move a task, as a status.
STATUS = {"created": "pending", "started": "running", "completed": "completed", "failed": "failed", "cancelled": "cancelled"}
#: All types that a task's events have.
TYPES = (*STATUS, "tool_call", "warning")


def ring(events: DataFrame, keep: int = PER_TASK) -> DataFrame:
    """The last ``keep`` events of each task (``task_id, seq``), all columns kept; a null task is one
    too, and a null sequence number comes before all others."""
    names = events.columns
    order = Window.partitionBy("row.task_id").orderBy(F.col("row.seq").desc())
    rows = events.select(_packed(names)).withColumn("back", F.row_number().over(order)).where(F.col("back") <= keep)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names])


def _packed(names: list[str]) -> Column:
    """All of a row in one struct, so that no column can clash with an operator's own."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in names]).alias("row")


def since(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events after each task's cursor, a sequence number that only grows."""
    return events.join(cursors, "task_id").where(F.col("seq") > F.col("cursor")).drop("cursor")


def next_cursors(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Each task's new cursor; a task without events keeps its own."""
    last = events.groupBy("task_id").agg(F.max("seq").alias("last"))
    return cursors.join(last, "task_id", "left").select("task_id", F.greatest("cursor", F.coalesce("last", F.col("cursor"))).alias("cursor"))


def feed(events: DataFrame, limit: int = 60) -> DataFrame:
    """The newest events (``limit`` is the feature)."""
    return events.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(limit)


def clear(events: DataFrame, tasks: DataFrame) -> DataFrame:
    return events.join(tasks.select("task_id"), "task_id", "left_anti").select(*events.columns)


def evict(events: DataFrame, per_task: int = PER_TASK, total: int = TOTAL, range_events: int = RANGE) -> DataFrame:
    """What a buffer holds after all events in order of ``arrival`` (then task).

    A queue loses events at its head only, so what stays of a task are its last ones: the buffer
    is known once it is known how many each task keeps. Each eviction depends on every earlier
    one, so numbers are followed in order of arrival; but events are first sorted in ranges of
    about ``range_events`` and runs of one task counted there, all ranges at once, and the
    ranges are then folded one after the other, each by a task that starts from the numbers
    before it: ``total`` of them at most, with no event. The events themselves meet nowhere; they
    are ranked task by task, and those within their task's number stay.

    A null task is one too; of one task's events with the same arrival any order may hold.
    """
    spark = events.sparkSession
    runs = fresh_path(spark, "runs")
    n = events.count()
    cut = events.select("arrival", "task_id").repartitionByRange(max(1, -(-n // range_events)), "arrival", "task_id").sortWithinPartitions("arrival", "task_id")
    kind = events.schema["task_id"].dataType.simpleString()
    cut.select("task_id").mapInPandas(_runs, f"range int, place long, task_id {kind}, n long").write.partitionBy("range").parquet(runs)
    held: list[tuple] = []
    read = spark.read.schema(f"place long, task_id {kind}, n long, range int").parquet(runs)
    for k in sorted(r["range"] for r in read.select("range").distinct().collect()):
        one = read.where(F.col("range") == k).select("place", "task_id", "n").coalesce(1).sortWithinPartitions("place")
        rows = one.mapInPandas(_folded(held, per_task, total), f"place long, task_id {kind}, n long").collect()
        held = [(r["task_id"], r["n"]) for r in sorted(rows, key=lambda r: r["place"])]
    delete(spark, runs)
    kept = F.broadcast(spark.createDataFrame(held, f"_task {kind}, _n long"))  # ``total`` rows at most
    names = events.columns
    order = Window.partitionBy("row.task_id").orderBy(F.col("row.arrival").desc())
    last = events.select(_packed(names)).withColumn("_back", F.row_number().over(order)).where(F.col("_back") <= per_task)
    stay = last.join(kept, F.col("row.task_id").eqNullSafe(F.col("_task"))).where("_back <= _n")
    return stay.select(*[F.col("row").getField(c).alias(c) for c in names])


def _plain(task):
    """A task as Python has it; null for what pandas takes as missing."""
    return None if pd.isna(task) else task.item() if hasattr(task, "item") else task


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one task in a sorted range: the range's number, places, tasks and lengths."""
    here, place, last = TaskContext.get().partitionId(), 0, None

    def made(runs: list[list]) -> pd.DataFrame:
        out = pd.DataFrame({"range": here, "place": range(place, place + len(runs)), "task_id": pd.Series([t for t, _ in runs], dtype=object), "n": [n for _, n in runs]})
        return out

    for batch in batches:
        runs = [last] if last else []
        for task in map(_plain, batch["task_id"]):
            if runs and runs[-1][0] == task:
                runs[-1][1] += 1
            else:
                runs.append([task, 1])
        last = runs.pop() if runs else None
        if runs:
            yield made(runs)
            place += len(runs)
    if last:
        yield made([last])


def _folded(held: list[tuple], per_task: int, total: int):
    """The numbers of each task in order of their queues, after a range's runs."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queues = OrderedDict(held)
        size = sum(queues.values())
        for batch in batches:
            for task, n in zip(map(_plain, batch["task_id"]), batch["n"].tolist(), strict=True):
                for _ in range(n):
                    if queues.get(task, 0) >= per_task:
                        continue  # its own head makes room
                    queues[task] = queues.get(task, 0) + 1
                    size += 1
                    while size > total:
                        first = next(iter(queues))
                        queues[first] -= 1
                        size -= 1
                        if not queues[first]:
                            del queues[first]
        yield pd.DataFrame({"place": range(len(queues)), "task_id": pd.Series(list(queues), dtype=object), "n": list(queues.values())})

    return fold


def by_type(events: DataFrame) -> DataFrame:
    """``type, known, events``: how many there are of each type, null too, and whether it is one
    of ``TYPES``."""
    known = F.coalesce(F.col("type").isin(*TYPES), F.lit(False))
    return events.groupBy("type").agg(F.count("*").alias("events")).select("type", known.alias("known"), "events")


def statuses(events: DataFrame) -> DataFrame:
    """Each task's status from its lifecycle events (``task_id, seq, type``): the first end
    stays; a task can be cancelled only before it starts."""
    known = events.where(F.col("type").isin(*STATUS))
    at = lambda t: F.min(F.when(F.col("type") == t, F.col("seq")))
    per = known.groupBy("task_id").agg(*[at(t).alias(t) for t in STATUS])
    cancelled = F.col("cancelled").isNotNull() & (F.col("started").isNull() | (F.col("cancelled") < F.col("started")))
    ended = F.when(F.coalesce(F.col("completed") < F.col("failed"), F.col("completed").isNotNull()), "completed").when(F.col("failed").isNotNull(), "failed")
    status = F.when(cancelled, "cancelled").otherwise(F.coalesce(ended, F.when(F.col("started").isNotNull(), "running"), F.lit("pending")))
    return per.select("task_id", status.alias("status"))


def metrics(tasks: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("status") == s)
    return tasks.agg(F.count("*").alias("total"), one("completed").alias("completed"), one("failed").alias("failed"))


def exposition(counts: DataFrame, prefix: str = "tasks") -> DataFrame:
    """The counters as a text page: help, type and value of each."""
    said = {"total": "Total tasks submitted", "completed": "Total tasks completed", "failed": "Total tasks failed"}
    parts = [F.format_string(f"# HELP {prefix}_{k} {v}\n# TYPE {prefix}_{k} counter\n{prefix}_{k} %d\n", k) for k, v in said.items()]
    return counts.select(F.concat(*parts).alias("page"))


def recent(tasks: DataFrame, limit: int = 8) -> DataFrame:
    """The newest tasks (``limit`` is the feature), by id from the greatest."""
    return tasks.orderBy(F.col("submit_seq").desc()).limit(limit)


def gauges(tasks: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Running tasks, the share of slots in per cent, and the bar's width."""
    n = F.count_if(F.col("status") == "running")
    used = F.floor(n / F.lit(float(slots)) * 100 + 0.5).cast("long")
    return tasks.agg(n.alias("running"), used.alias("used"), F.least(used, F.lit(100).cast("long")).alias("width"))
