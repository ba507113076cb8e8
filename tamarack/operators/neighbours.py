"""Nearest vectors by equi joins: exact in blocks, or approximate through coarse cells.

A cell is what lies nearest to one of a number of centroids. Centroids are fitted on at most
``SAMPLE`` vectors (those of least hash of their uid), and so is the number of cells that a
query looks at: the least with which ``RECALL`` of the sample's own neighbours are found. Every
vector is indexed, in its cell; a query goes to its nearest cells and meets their vectors in a
join. A cell of more than ``ROWS`` vectors is cut into shards and one of more than ``ASKED``
queries into blocks of them, so a task holds one shard and one block, whatever share of all
rows a cell has; smaller ones are cut as well, as long as there are too few tasks. A vector is
shuffled once a block and a query once a shard, so shards and blocks are as large as a task can
hold, and the distances between them are taken ``PRODUCTS`` at a time. Only the sample, and
counts by cell, come to the driver.

Exact search is the same join with one cell.

Defined cases: null vectors, and those with a null element or of another length than the
centroids', are in no cell and no one's hits; a query like that has no hits; a null query_id is
a query as well; ties go by uid; an empty index gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.ranking import ranked

SAMPLE = 20_000
MOST_CELLS = 1024
RECALL = 0.95
ROWS, ASKED = 1 << 16, 1 << 16
#: Shards and blocks of this size at most aren't cut further to make tasks, of which each core gets ``TASKS``.
LEAST, TASKS = 1024, 4
#: Distances held at once.
PRODUCTS = 1 << 22
ITERATIONS = 8
#: What a product of matrices may be off by: it only chooses, distances are then taken exactly.
SLACK = 1e-5
HIT = "query_id long, uid string, score double"


class Cells(NamedTuple):
    """Centroids, and how many of their cells a query looks at."""

    centroids: np.ndarray
    probes: int


def usable(vector: Column) -> Column:
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull()), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _far(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all others, by one product."""
    return np.einsum("ij,ij->i", points, points)[:, None] - 2 * (points @ to.T) + np.einsum("ij,ij->i", to, to)[None]


# --- cells --------------------------------------------------------------------------------


def fit(vectors: DataFrame, cells: int | None = None, recall: float = RECALL, limit: int = 10, sample: int = SAMPLE) -> Cells:
    """Cells for ``vectors`` (``uid, embedding``): by default the square root of their number,
    ``MOST_CELLS`` at most. The sample's most frequent length is the index's."""
    rows = vectors.where(usable(F.col("embedding")) & (F.size("embedding") > 0))
    cells = cells or min(MOST_CELLS, max(1, round(rows.count() ** 0.5)))
    drawn = rows.select("embedding", F.xxhash64("uid").alias("h"), "uid").orderBy("h", "uid").limit(sample).collect()
    sizes = [len(r["embedding"]) for r in drawn]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    x = np.array([r["embedding"] for r in drawn if len(r["embedding"]) == size], np.float64).reshape(-1, max(size, 1))
    x = x[np.isfinite(x).all(1)]
    if not len(x):
        return Cells(np.empty((0, 0)), 0)
    centroids = np.unique(x[:cells], axis=0)
    for _ in range(ITERATIONS):
        own = _far(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centroids))[:, None]
        centroids = np.where(n > 0, sums / np.maximum(n, 1), centroids)
    return Cells(centroids, _probes(x, centroids, recall, limit))


def _probes(x: np.ndarray, centroids: np.ndarray, recall: float, limit: int) -> int:
    """The fewest cells that find ``recall`` of the sample's neighbours in the sample."""
    own = _far(x, centroids).argmin(1)
    asked = x[:: max(1, len(x) // 500)]
    top = np.argsort(_far(asked, x), axis=1)[:, :limit]
    order = np.argsort(_far(asked, centroids), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
    needed = np.take_along_axis(place, own[top], 1).ravel()
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def _placed(cells: Cells, most: int):
    """Rows (id, embedding) with the numbers of their ``most`` nearest cells."""
    size = cells.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _far(_matrix(batch.column(1), size), cells.centroids)
            near = np.argsort(far, axis=1, kind="stable")[:, :most] if most > 1 else far.argmin(1)[:, None]
            at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], names=["cell", batch.schema.names[0], "embedding"])

    return run


def _fitting(rows: DataFrame, key: str, cells: Cells) -> DataFrame:
    return rows.where(usable(F.col("embedding")) & (F.size("embedding") == cells.centroids.shape[1])).select(key, F.col("embedding").cast("array<double>").alias("embedding"))


def indexed(vectors: DataFrame, cells: Cells) -> DataFrame:
    """``cell, uid, embedding`` of every vector that fits; write it by ``cell`` to search it again."""
    return _fitting(vectors, "uid", cells).mapInArrow(_placed(cells, 1), "cell int, uid string, embedding array<double>")


def probed(queries: DataFrame, cells: Cells) -> DataFrame:
    """``cell, query_id, embedding``: each query once for every cell it looks at."""
    return _fitting(queries, "query_id", cells).mapInArrow(_placed(cells, cells.probes), "cell int, query_id long, embedding array<double>")


# --- the join -----------------------------------------------------------------------------


def _met(limit: int):
    """The best ``limit`` rows of a shard for each query of a block."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "uid": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        if not len(rows) or not len(asked):
            return none
        size = len(rows["embedding"][0])
        x, q = _matrix(rows["embedding"], size), _matrix(asked["embedding"], size)
        which, at, score = [], [], []
        step = max(1, PRODUCTS // len(x))
        for begin in range(0, len(q), step):
            some = q[begin : begin + step]
            near = _far(some, x)
            border = np.partition(near, limit - 1, axis=1)[:, limit - 1] if len(x) > limit else np.full(len(some), np.inf)
            i, j = np.nonzero(near <= border[:, None] + SLACK)
            gone = some[i] - x[j]
            which.append(begin + i)
            at.append(j)
            score.append(np.round(-np.einsum("ij,ij->i", gone, gone), 6) + 0.0)
        which, at, score = np.concatenate(which), np.concatenate(at), np.concatenate(score)
        uid = rows["uid"].combine_chunks()
        by_name = np.empty(len(x), np.int64)
        by_name[pc.sort_indices(uid).to_numpy()] = np.arange(len(x))
        order = np.lexsort((by_name[at], -score, which))
        begins = np.searchsorted(which[order], np.arange(len(q)))
        kept = order[np.arange(len(order)) - begins[which[order]] < limit]
        return pa.table({"query_id": asked["query_id"].take(pa.array(which[kept])), "uid": uid.take(pa.array(at[kept])), "score": score[kept]})

    return run


def cuts(held: dict[int, int], wanted: dict[int, int], cores: int) -> list[tuple[int, int, int]]:
    """Into how many shards and blocks each cell with so many vectors and queries is cut."""
    met = [c for c in held if c in wanted]
    side = max(LEAST, int((sum(held[c] * wanted[c] for c in met) / (TASKS * cores)) ** 0.5))
    return [(c, -(-held[c] // min(ROWS, side)), -(-wanted[c] // min(ASKED, side))) for c in met]


def joined(rows: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """``query_id, uid, score`` of the best ``limit`` rows (``cell, uid, embedding``) of each cell
    for each query that is there (``cell, query_id, embedding``), shard by shard."""
    spark = rows.sparkSession
    count = lambda df: {r["cell"]: r["count"] for r in df.groupBy("cell").count().collect()}
    held, wanted = count(rows), count(asked)
    plan = F.broadcast(spark.createDataFrame(cuts(held, wanted, spark.sparkContext.defaultParallelism), "cell int, shards int, blocks int"))  # a row a cell
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = rows.join(plan, "cell").select("cell", part("uid", "shards").alias("shard"), each("blocks").alias("block"), "uid", "embedding")
    right = asked.join(plan, "cell").select("cell", each("shards").alias("shard"), part("query_id", "blocks").alias("block"), "query_id", "embedding")
    keys = ("cell", "shard", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_met(limit), HIT)


def search(index: DataFrame, queries: DataFrame, cells: Cells, limit: int = 10) -> DataFrame:
    """``query_id, uid, score, vector_rank``: the best ``limit`` of the cells each query looks at."""
    if not cells.probes:
        return ranked(queries.sparkSession.createDataFrame([], HIT), limit, "vector_rank")
    return ranked(joined(index, probed(queries, cells), limit), limit, "vector_rank")


def exact(vectors: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """``query_id, uid, score``: every vector against every query of its length, block by block."""
    def whole(df: DataFrame, key: str) -> DataFrame:
        # single precision is half as much to shuffle; tasks compute in double precision anyway
        kind = "array<float>" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
        return df.where(usable(F.col("embedding"))).select(F.size("embedding").alias("cell"), key, F.col("embedding").cast(kind).alias("embedding"))

    return joined(whole(vectors, "uid").where("cell > 0"), whole(queries, "query_id").where("cell > 0"), limit)
