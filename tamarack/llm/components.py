"""Connected components of a table of links, by contraction.

Each round maps every component to the least of itself and its neighbours, relabels the
links, drops those inside a component and repeats. A round leaves at least the components
that are least among their neighbours; every other one moves, so a chain shrinks by the
length of its falling runs and a star at once, or in two rounds if its centre is not its
least node. Once ``FEW`` links or fewer are left (a counted bound), one task joins what they
still connect. Hot labels are looked up by broadcasts, so a component of any size spreads
over tasks.

Defined cases: links from a node to itself and links with a null end are ignored; repeated
links count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, looked_up

FEW = 20_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``c, m``: every node of at most ``FEW`` links and the least node it is connected with."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["c", "m"])


def label(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``): label is its component's least node."""
    edges = keep(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    while n := edges.count():
        if n <= FEW:
            to = edges.select("a", "b").coalesce(1).mapInArrow(_joined, "c long, m long")
        else:
            to = edges.select(F.col("b").alias("c"), F.col("a").alias("m")).groupBy("c").agg(F.min("m").alias("m"))
        to = keep(to, "cc-map")  # every component with a lesser one moves there
        moved = lambda rows, at: looked_up(rows, to.withColumnsRenamed({"c": at, "m": "__to"}), at).withColumn(at, F.coalesce("__to", at)).drop("__to")  # noqa: B023, E731
        labels = moved(labels, "label").select("node", "label")
        if n <= FEW:
            break
        left = moved(moved(edges, "a"), "b")
        edges = keep(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    return keep(labels, "cc-labels")
