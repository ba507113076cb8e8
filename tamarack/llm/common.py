"""Shared pieces: columns, word splitting, shared-storage tables, guarded broadcasts."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A side with more rows than this is never broadcast by ``guarded``.
BROADCAST_ROWS = 50_000


#: Bytes of a batch that goes to a Python worker, unless the session sets its own: workers hold a few of them.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARKS_OWN = 64 << 20


def bounded(spark: SparkSession) -> None:
    """Batches to Python workers of at most ``BATCH_BYTES``, where the session keeps Spark's default."""
    if spark.conf.get(_BATCH).rstrip("b") == str(_SPARKS_OWN):
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words in ``text``; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- columns ------------------------------------------------------------------------------


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(names: list[str]) -> Column:
    """All of a row in one struct, so that no column of its can clash with an operator's."""
    return F.struct(*map(col, names)).alias("row")


def unpacked(names: list[str], **changed: Column) -> list[Column]:
    """The columns of ``packed`` again, those of ``changed`` with their new values."""
    return [changed.get(c, F.col("row").getField(c)).alias(c) for c in names]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once: however the optimizer moves expressions, what a
    lambda refers to is a variable, never the expression itself."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- tables in shared storage -------------------------------------------------------------

#: Paths of kept tables by scope; the outermost lasts as long as the session.
_scopes: list[list[tuple[SparkSession, str]]] = [[]]


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors see."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return where.rstrip("/")


def keep(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to shared storage, in folders by the column ``by``, and read it back:
    lineage ends there.

    A lost executor then costs a re-read, never a recomputation of what lies before.
    """
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_root(spark)}/tamarack-{tag}-{uuid.uuid4().hex}"
    _scopes[-1].append((spark, path))
    with _tidy(spark):
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


#: Spark's own setting: a job's shuffle files go when its query ends, not when the driver collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*kept: DataFrame) -> None:
    """Delete tables of ``keep`` that nothing reads any more."""
    for df in kept:
        _delete(df.sparkSession, df._kept_at)
        for scope in _scopes:
            scope[:] = [x for x in scope if x[1] != df._kept_at]


def forget(kept: DataFrame, folder: str) -> None:
    """Delete one folder of a table kept by a column, when nothing reads it any more."""
    _delete(kept.sparkSession, f"{kept._kept_at}/{folder}")


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables kept inside are deleted at the end, but for those given to what this yields."""
    own: list[tuple[SparkSession, str]] = []
    spared: set[str] = set()

    def spare(kept: DataFrame) -> DataFrame:
        spared.add(kept._kept_at)
        return kept

    _scopes.append(own)
    try:
        yield spare
    finally:
        _scopes.remove(own)
        for spark, path in own:
            if path in spared:
                _scopes[-1].append((spark, path))
            else:
                _delete(spark, path)


@atexit.register
def _leave() -> None:
    for spark, path in _scopes[0]:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


#: A table of so many rows (of two numbers) at most is broadcast by ``looked_up``.
LOOKUP_ROWS = 200_000
#: Keys with more rows than this may be hot.
HOT_ROWS = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row a ``key``), whatever share of ``rows`` one key has.

    A counted small table is broadcast. Else keys with more than ``HOT_ROWS`` rows, and more
    than one in ``BROADCAST_ROWS`` of all, are joined by a broadcast (there can be no more than
    ``BROADCAST_ROWS`` of them), and the others by a shuffle.
    """
    if table.count() <= LOOKUP_ROWS:
        return rows.join(F.broadcast(table), key, "left")
    least = max(HOT_ROWS, rows.count() // BROADCAST_ROWS)
    hot = rows.groupBy(key).count().where(F.col("count") > least).select(key)
    hot = keep(hot.join(table, key, "left"), "hot-keys")
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key, "left")
    return others.unionByName(rows.join(F.broadcast(hot), key))


def guarded(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only while ``rows`` (a counted size) stays under the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
