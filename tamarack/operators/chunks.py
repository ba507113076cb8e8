"""Cutting files into chunks and lines."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import has_text, lines

WINDOW = 30
MIN_DEFINITION = 10
CHUNK = "file string, start_line int, end_line int, content string"


def fixed(files: DataFrame, window: int = WINDOW) -> DataFrame:
    """``file, start_line, end_line, content`` from ``file, content``: windows of lines, blank
    ones dropped. Windows are slices of the row's own array, so nothing is shuffled."""
    none = F.lit(None).cast("int")
    return _windows(files.select("file", none.alias("start_line"), none.alias("end_line"), "content"), window)


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """Rows with a start line as they are, the others' contents in windows."""
    cut = rows.select("file", "start_line", "end_line", "content", F.when(F.col("start_line").isNull(), lines(F.col("content"))).alias("l"))
    n = F.size("l")
    starts = F.when(F.col("l").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(window)))
    made = cut.withColumn("n", n).withColumn("s", F.explode(starts))
    made = made.select(
        "file",
        F.coalesce("start_line", F.col("s") + 1).alias("start_line"),
        F.coalesce("end_line", F.least(F.col("s") + window, F.col("n"))).alias("end_line"),
        F.when(F.col("l").isNull(), F.col("content")).otherwise(F.array_join(F.slice("l", F.col("s") + 1, F.lit(window)), "\n")).alias("content"),
    )
    return made.where(has_text(F.col("content")))


def definitions(content: str) -> list[tuple[int, int, str]]:
    """First and last line and source of each top-level definition; none on a syntax error."""
    try:
        body = ast.parse(content).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    rows = content.split("\n")
    found = [x for x in body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    out = [(x.lineno, x.end_lineno, "\n".join(rows[x.lineno - 1 : x.end_lineno])) for x in found]
    return [x for x in out if len(x[2].strip()) >= MIN_DEFINITION]


def python(files: DataFrame) -> DataFrame:
    """Top-level definitions of Python sources, or the whole content without lines where there
    is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, content in zip(batch["file"], batch["content"], strict=True):
                found = definitions(content or "")
                out += [(file, *x) for x in found] or [(file, None, None, content)]
            frame = pd.DataFrame(out, columns=["file", "start_line", "end_line", "content"])
            yield frame.astype({"start_line": "Int32", "end_line": "Int32"})

    return files.select("file", "content").mapInPandas(run, CHUNK)


def chunk(files: DataFrame, window: int = WINDOW) -> DataFrame:
    """Definitions of ``.py`` files, windows of the others and of those without definitions.

    Each source is parsed once, and nothing is shuffled.
    """
    is_python = F.coalesce(F.col("file").endswith(".py"), F.lit(False))
    none = F.lit(None).cast("int")
    rest = files.where(~is_python).select("file", none.alias("start_line"), none.alias("end_line"), "content")
    return _windows(python(files.where(is_python)).unionByName(rest), window)


def uid(file: str = "file") -> F.Column:
    return F.format_string("%s:%d-%d", file, "start_line", "end_line")


def line_slice(files: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """``file, line_no, line``: numbered lines of a range, first from 0, last exclusive."""
    rows = files.select("file", F.posexplode(lines(F.col("content"))).alias("pos", "raw")).where(F.col("pos") >= start)
    rows = rows if end is None else rows.where(F.col("pos") < end)
    number = (F.col("pos") + 1).cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, " ")).otherwise(number)
    return rows.select("file", (F.col("pos") + 1).alias("line_no"), F.concat(padded, F.lit(" | "), F.col("raw")).alias("line"))


def regex_search(files: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """The first ``limit`` matching lines by file, then line (``limit`` is the feature).

    The pattern is held against each line, so ``^`` and ``$`` are a line's ends; no match gives
    no row, an invalid pattern a ``ValueError``.
    """
    try:
        files.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as wrong:  # what the JVM throws arrives under several names
        raise ValueError(f"invalid pattern: {pattern}") from wrong
    rows = files.select("file", F.posexplode(lines(F.col("content"))).alias("pos", "raw"))
    hit = rows.where(F.col("raw").rlike(pattern)).select(
        "file", (F.col("pos") + 1).alias("line_no"), F.substring(F.regexp_replace("raw", r"(?U)^\s+|\s+$", ""), 1, 120).alias("line")
    )
    return hit.orderBy("file", "line_no").limit(limit)
