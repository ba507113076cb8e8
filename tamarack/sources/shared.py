"""The folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

#: Bytes of a batch that goes to a Python worker, unless the session sets its own: workers hold a few of them.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARKS_OWN = 64 << 20

_fresh: list[tuple[SparkSession, str]] = []


def bounded(spark: SparkSession) -> None:
    """Batches to Python workers of at most ``BATCH_BYTES``, where the session keeps Spark's default."""
    if spark.conf.get(_BATCH).rstrip("b") == str(_SPARKS_OWN):
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def shared_root(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names, or an error."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return where.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path under the shared folder that nothing uses; what is put there goes when the session ends."""
    path = f"{shared_root(spark)}/tamarack-{tag}-{uuid.uuid4().hex}"
    _fresh.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _leave() -> None:
    for spark, path in _fresh:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
