"""Text of web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.sources.shared import bounded

#: Elements without readable text, and those that have no end tag.
DROPPED = frozenset(("script", "style", "nav", "footer", "header", "aside"))
EMPTY = "[empty] the page has no text"
MOST = 4000
#: Characters that a task gives at once.
BATCH = 1 << 20


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts, self.open = 0, [], ""

    def _flush(self):
        if self.open.strip():
            self.parts.append(self.open.strip())
        self.open = ""

    def handle_starttag(self, tag, attrs):
        self._flush()
        self.depth += tag in DROPPED

    def handle_endtag(self, tag):
        self._flush()
        self.depth -= tag in DROPPED and self.depth > 0

    def handle_startendtag(self, tag, attrs):
        self._flush()

    def handle_comment(self, data):
        self._flush()

    def handle_data(self, data):
        if not self.depth:
            self.open += data


def readable(html: str) -> str:
    """Text nodes, stripped, a line each, without those of dropped elements."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._flush()
    return "\n".join(reader.parts)


def cut(text: str, most: int = MOST) -> str:
    if not text.strip():
        return EMPTY
    return text if len(text) <= most else f"{text[:most]}\n...[cut, {len(text)} characters in all]"


def page_text(pages: DataFrame, most: int = MOST) -> DataFrame:
    """``page_id, text, n_chars``: at most ``most`` characters and the length of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, texts, sizes, held = batch.column(0), 0, [], [], 0
            for k, html in enumerate(batch.column(1), 1):
                text = readable(html.as_py())  # one page at a time
                texts.append(cut(text, most))
                sizes.append(len(text))
                held += len(texts[-1])
                if held > BATCH or k == len(ids):
                    yield pa.RecordBatch.from_arrays([ids.slice(first, k - first), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "text", "n_chars"])
                    first, texts, sizes, held = k, [], [], 0

    bounded(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, text string, n_chars long")
