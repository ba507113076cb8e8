"""Keeping an index in step with its files: differences of snapshots, deletes, upserts."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.chunks import WINDOW, chunk, uid
from tamarack.sources.files import contents, listed


class Built(NamedTuple):
    """A new index, the state that goes with it, and what was done."""

    index: DataFrame
    state: DataFrame
    summary: DataFrame


def diff(disk: DataFrame, state: DataFrame) -> DataFrame:
    """``file, change``: new, changed (time differs in any way), unchanged or deleted."""
    d, s = disk.select("file", F.col("mtime").alias("now")), state.select("file", F.col("mtime").alias("then"))
    change = (
        F.when(F.col("now").isNull(), "deleted").when(F.col("then").isNull(), "new").when(F.col("now") == F.col("then"), "unchanged").otherwise("changed")
    )
    return d.join(s, "file", "full_outer").select("file", change.alias("change"))


def delete_files(index: DataFrame, gone: DataFrame) -> DataFrame:
    return index.join(gone.select("file").distinct(), "file", "left_anti").select(*index.columns)


def upsert(index: DataFrame, fresh: DataFrame, key: str = "uid") -> DataFrame:
    """Rows of ``fresh``, and those of ``index`` whose key isn't among them."""
    return index.join(fresh.select(key), key, "left_anti").select(*index.columns).unionByName(fresh.select(*index.columns))


def refresh(index: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Delete what is gone or changed, then put the fresh chunks in."""
    return upsert(delete_files(index, changes.where("change in ('deleted', 'changed')")), fresh)


def next_state(disk: DataFrame) -> DataFrame:
    return disk.select("file", "mtime")


def summary(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Files and chunks of the index, files removed."""
    made = chunks.agg(F.countDistinct("file").alias("files"), F.count("*").alias("chunks"))
    return made.crossJoin(F.broadcast(changes.agg(F.count_if(F.col("change") == "deleted").alias("removed"))))


def build(
    files: DataFrame,
    state: DataFrame,
    index: DataFrame | None = None,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    force: bool = False,
    window: int = WINDOW,
    read: Callable[[DataFrame], DataFrame] | None = None,
) -> Built:
    """Bring an index up to date with ``files`` (``file, mtime``, and ``content`` unless ``read`` is
    given).

    New and changed files are cut into chunks (``uid, file, start_line, end_line, document``),
    ``embed`` adds what columns it likes to these alone, and they replace the file's old chunks;
    chunks of deleted files go. ``read`` gets the rows of new and changed files only and gives
    their ``file, content``: no other file is opened. ``force`` forgets state and index. Without
    an index all files are fresh, whatever the state says. The summary is one row: ``files`` and
    ``chunks`` indexed, ``removed`` files, ``up_to_date``. Write the results elsewhere than where
    their inputs are read from.

    Defined cases: a null content is an empty file, which has no chunks; a file without name is
    none; of a name that occurs twice the row of the latest ``mtime`` counts (then of the greatest
    content); uids are unique, as two chunks of one file and the same lines are the same.
    """
    if force or index is None:
        state = state.limit(0)
    own = [c for c in files.columns if c != "file"]
    rank = F.struct(F.col("mtime"), *([F.col("content")] if "content" in own else []), *[F.col(c) for c in own if c not in ("mtime", "content")])
    files = files.where("file is not null").groupBy("file").agg(F.max(rank).alias("r")).select("file", *[F.col("r").getField(c).alias(c) for c in own])
    changes = diff(files.select("file", "mtime"), state)
    todo = changes.where("change in ('new', 'changed')").select("file")
    wanted = files.join(todo, "file", "left_semi")
    cut = chunk(read(wanted) if read else wanted.select("file", "content"), window)
    fresh = cut.select(uid().alias("uid"), "file", "start_line", "end_line", F.col("content").alias("document")).dropDuplicates(["uid"])
    counts = changes.agg(F.count_if(F.col("change").isin("new", "changed")).alias("files"), F.count_if(F.col("change") == "deleted").alias("removed"))
    told = counts.crossJoin(F.broadcast(fresh.agg(F.count("*").alias("chunks"))))
    told = told.select("files", "chunks", "removed", (F.col("files") + F.col("removed") == 0).alias("up_to_date"))
    made = embed(fresh) if embed else fresh
    whole = made if force or index is None else refresh(index, changes, made)
    return Built(whole, next_state(files), told)


def build_folder(
    spark: SparkSession,
    root: str,
    state: DataFrame,
    index: DataFrame | None = None,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    force: bool = False,
    window: int = WINDOW,
) -> Built:
    """``build`` over the wanted files under ``root``: all are listed, new and changed ones read."""
    return build(listed(spark, root), state, index, embed, force, window, contents)
