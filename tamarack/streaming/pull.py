"""Pulling a stream of events once, whatever fails.

A batch is one step: its new events and their tasks' new cursors are written under the batch's
number, the cursors last. A batch that is tried again writes over what the failed try left,
and reads cursors of earlier batches only, so it comes to the same rows; what readers see are
the batches with cursors. An event whose sequence number isn't above its task's cursor was
shown before, or came too late to be shown.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CURSORS = "task_id long, last long, whole boolean"
#: Every so many batches write the cursors of all tasks, so that readers need none before.
EVERY = 100


def _marks(spark: SparkSession, where: str) -> list[tuple[int, bool]]:
    """Finished batches by number, and whether each has all tasks' cursors."""
    try:
        rows = spark.read.schema(f"{CURSORS}, batch long").parquet(f"{where}/cursors")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((r["batch"], r["whole"]) for r in rows.where("whole is not null").select("batch", "whole").collect())


def cursors(spark: SparkSession, where: str, before: int | None = None) -> DataFrame:
    """``task_id, cursor`` after all batches, or those before one."""
    marks = [x for x in _marks(spark, where) if before is None or x[0] < before]
    since = max((k for k, whole in marks if whole), default=-1)
    some = [f"{where}/cursors/batch={k}" for k, _ in marks if k >= since]
    if not some:
        return spark.createDataFrame([], "task_id long, cursor long")
    rows = spark.read.schema(CURSORS).parquet(*some).where("whole is null")
    return rows.groupBy("task_id").agg(F.max("last").alias("cursor"))


def shown(spark: SparkSession, where: str) -> DataFrame:
    """``batch`` and the events of every finished batch."""
    some = [f"{where}/shown/batch={k}" for k, _ in _marks(spark, where)]
    if not some:
        raise LookupError(f"nothing has been pulled to {where} yet")
    return spark.read.option("basePath", f"{where}/shown").parquet(*some)


def step(batch: DataFrame, number: int, where: str) -> None:
    """Write a batch (``task_id, seq`` and more), events first and cursors last.

    The cursors' table has one more row, the mark of a finished batch.
    """
    spark = batch.sparkSession
    seen = cursors(spark, where, number)
    known = seen.withColumnRenamed("task_id", "_task")
    fresh = batch.dropDuplicates(["task_id", "seq"]).join(known, F.col("task_id").eqNullSafe(F.col("_task")), "left")
    fresh = fresh.where(F.col("cursor").isNull() | (F.col("seq") > F.col("cursor"))).drop("_task", "cursor")
    out = f"{where}/shown/batch={number}"
    fresh.write.mode("overwrite").parquet(out)
    whole = number % EVERY == EVERY - 1
    last = spark.read.schema(fresh.schema).parquet(out).select("task_id", F.col("seq").alias("last"))
    last = last.unionByName(seen.select("task_id", F.col("cursor").alias("last"))) if whole else last
    last = last.groupBy("task_id").agg(F.max("last").alias("last")).withColumn("whole", F.lit(None).cast("boolean"))
    finish(last, whole, f"{where}/cursors/batch={number}")


def finish(last: DataFrame, whole: bool, path: str) -> None:
    """Write a batch's cursors with its mark: from here on it is shown."""
    mark = last.sparkSession.createDataFrame([(None, None, whole)], CURSORS)
    last.unionByName(mark).write.mode("overwrite").parquet(path)


def pull(events: DataFrame, where: str, checkpoint: str, seconds: int | None = 4) -> StreamingQuery:
    """Start pulling to the shared folder ``where``, every ``seconds`` (None: once, all that is there)."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return events.writeStream.foreachBatch(lambda batch, number: step(batch, number, where)).option("checkpointLocation", checkpoint).trigger(**trigger).start()

