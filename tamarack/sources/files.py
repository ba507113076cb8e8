"""Files as tables, and tables as files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.sources.folder import FolderSource, opened, there
from tamarack.sources.shared import bounded

#: Folders that are passed over, and suffixes that are read.
SKIP = (".git", "node_modules", "__pycache__", ".venv", "venv", ".idea", ".vscode")
SEARCHED = (
    ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rs", ".html", ".css", ".vue", ".yaml", ".yml",
    ".json", ".md", ".txt", ".sh", ".sql", ".xml", ".toml", ".cfg", ".ini",
)
#: Folders that an index keeps beside the files.
OWN = (".tamarack",)
STATE_FILES = 10_000
#: Bytes that a task reads, and characters that it gives at once.
TASK_BYTES, BATCH = 64 << 20, 1 << 20
INDEXED = (*SEARCHED, ".cpp", ".c", ".h")


def wanted(file: Column, suffixes: tuple[str, ...] = INDEXED, skip: tuple[str, ...] = SKIP) -> Column:
    """Whether a relative path has a wanted suffix and no folder of ``skip``."""
    name = F.element_at(F.split(file, "/"), -1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return suffix.isin(*suffixes) & ~F.arrays_overlap(F.split(file, "/"), F.array(*map(F.lit, skip)))


def entries(spark: SparkSession, root: str, skip: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """``file, path, is_folder, mtime, size`` of all entries under ``root``, without opening one;
    no such folder is a ``FileNotFoundError``."""
    if not there(root):
        raise FileNotFoundError(root)
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").option("skip", ",".join(skip)).option("recursive", str(recursive)).load(root)


def listed(spark: SparkSession, root: str, suffixes: tuple[str, ...] = INDEXED, skip: tuple[str, ...] = SKIP, own: tuple[str, ...] = OWN) -> DataFrame:
    """``file, path, mtime, size`` of every wanted file under ``root``: the folders of ``skip``,
    and those that an index keeps for itself (``own``), aren't entered, and no file is opened."""
    rows = entries(spark, root, (*skip, *own)).where(~F.col("is_folder"))
    return rows.where(wanted(F.col("file"), suffixes, (*skip, *own))).select("file", "path", "mtime", "size")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of files, a few megabytes at a time; bytes that aren't UTF-8 are dropped."""
    for batch in batches:
        out, held = [], 0
        for file, path in zip(batch["file"], batch["path"], strict=True):
            store, plain = opened(path)
            try:
                with store.open_input_stream(plain) as stream:
                    text = stream.read().decode("utf-8", "ignore")
            except OSError:  # gone or locked meanwhile
                text = None
            out.append((file, text))
            held += len(text or "")
            if held > BATCH:
                yield pd.DataFrame(out, columns=["file", "content"])
                out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=["file", "content"])


def contents(chosen: DataFrame) -> DataFrame:
    """``file, content`` of the files of a listing (``file, path, size``), and of no others.

    Names are dealt out to a task for every ``TASK_BYTES``; each task opens its own files. A file
    that can't be read has a null content.
    """
    total = chosen.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-int(total) // TASK_BYTES))
    return chosen.select("file", "path").repartition(tasks, "path").mapInPandas(_read, "file string, content string")


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = INDEXED, skip: tuple[str, ...] = SKIP, own: tuple[str, ...] = OWN) -> DataFrame:
    """``file, mtime, size, content`` of every wanted file under ``root``; others are listed at
    most, never opened."""
    found = listed(spark, root, suffixes, skip, own)
    return found.select("file", "mtime", "size").join(contents(found), "file")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Entries right under ``folder`` by name, hidden ones too, folders with a slash; an empty
    folder gives no row, and none at all a ``FileNotFoundError``."""
    rows = entries(spark, folder, recursive=False)
    return rows.select(F.concat("file", F.when(F.col("is_folder"), "/").otherwise("")).alias("entry")).orderBy("entry")


def write_files(rows: DataFrame, root: str) -> None:
    """Each row (``file, content``) as a file under ``root``, parents created; existing ones are replaced."""
    bounded(rows.sparkSession)
    rows.sparkSession.dataSource.register(FolderSource)
    rows.select("file", "content").write.format("folder").mode("append").save(root)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``uid, file, document`` of an index; missing texts are empty."""
    got = spark.read.parquet(path)
    return got.select("uid", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("document", F.lit("")).alias("document"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """``file, mtime`` of a JSON map; a corrupt file is an empty state."""
    got = spark.read.option("wholetext", True).text(path)
    state = F.from_json("value", "map<string,double>", {"mode": "PERMISSIVE"})
    return got.select(F.explode(state).alias("file", "mtime"))


def write_state(state: DataFrame, path: str) -> None:
    """JSON maps of about ``STATE_FILES`` entries, a file each, as ``read_state`` reads them.

    A state read from ``path`` itself must be written elsewhere: nothing is overwritten while
    it is read.
    """
    buckets = max(1, -(-state.count() // STATE_FILES))
    per = state.groupBy(F.pmod(F.xxhash64("file"), F.lit(buckets)).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("file", "mtime"))).alias("m"))
    per.select(F.to_json("m").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query string, relevant array<string>").option("multiLine", True).json(path)


def write_text(pages: DataFrame, path: str) -> None:
    pages.coalesce(1).write.mode("overwrite").text(path)
