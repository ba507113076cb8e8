"""Centroid clustering by delta Lloyd, in whole numbers.

Every vector's owner (its nearest centroid) and distance are kept in shared storage, and so are
the centroids' sums and sizes. A round compares a vector with the centroids that changed since
the last one, and with all of them only if its own centroid is among these: an unchanged
owner's distance still holds, and an unchanged centroid that lost then loses again. Vectors
whose owner changes are written apart; of these alone the next sums are made, as signed
transfers (out of the old owner, into the new one) added up by task and then by centroid.

Components are scaled and floored to integers, so sums, means (floored) and distances are
exact in any order of work. Centroids, their sums and the counts by centroid
(``CLUSTERS`` of ``SIZE`` numbers) are all that comes to the driver or is sent to the tasks.

Defined cases: vectors of another length than ``SIZE``, null ones and those with a null or
non-finite component are left out; fewer vectors than ``CLUSTERS`` give as many centroids;
repeated rows count each and equal vectors share an owner; a null id is drawn as an empty one;
ties go to the smaller number; an empty table gives an empty result. A scaled component beyond
``LARGEST`` is an error, since its distances would not fit a long. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, discard, keep

SIZE = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = "1"
LARGEST = 1 << 27
#: Products of so large components are exact in doubles.
EXACT = 1 << 22
#: Vectors compared at once.
TILE = 8192
_OUT = "id long, v array<int>, owner int, distance long, was int, moved boolean"


def prepared(vectors: DataFrame, id_column: str = "vec_id", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``id, v`` of the vectors that take part: scaled, floored components."""
    x = F.col("x")
    usable = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(col(id_column).alias("id"), col("embedding").cast("array<double>").alias("x")).where(F.coalesce(usable, F.lit(False)))
    fits = lambda c: F.when(F.abs(c) <= LARGEST, c.cast("int")).otherwise(F.raise_error(F.lit(f"a scaled component is beyond {LARGEST}")).cast("int"))
    return rows.select("id", F.transform("x", lambda c: fits(F.floor(F.lit(float(scale)) * c))).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors of least hash of seed and id, in that order; equal hashes go by components."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    top = vectors.select(draw.alias("draw"), "v").orderBy("draw", "v").limit(clusters).collect()
    return np.array([r["v"] for r in top], np.int64)


# --- a round ------------------------------------------------------------------------------


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, ties to the smaller number."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        far = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
        at = far.argmin(1)
        return at, far[np.arange(len(x)), at].astype(np.int64)
    far = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at]


def compared(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances: all centroids for rows whose owner changed (or that have none),
    only the changed ones for the others."""
    owner, distance = owner.copy(), distance.copy()
    loose = (owner < 0) | changed[owner]
    if loose.any():
        owner[loose], distance[loose] = nearest(x[loose], centroids)
    fixed = np.flatnonzero(~loose)
    some = np.flatnonzero(changed)
    if len(fixed) and len(some):
        at, far = nearest(x[fixed], centroids[some])
        at = some[at]
        wins = (far < distance[fixed]) | ((far == distance[fixed]) & (at < owner[fixed]))
        owner[fixed[wins]], distance[fixed[wins]] = at[wins], far[wins]
    return owner, distance


def _round(size: int, centroids: np.ndarray, changed: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TILE):
                batch = whole.slice(start, TILE)
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)
                was = batch.column("owner").to_numpy(zero_copy_only=False).astype(np.int64)
                owner, distance = compared(x, was, batch.column("distance").to_numpy(zero_copy_only=False), centroids, changed)
                cells = [batch.column("id"), batch.column("v"), pa.array(owner, pa.int32()), pa.array(distance), pa.array(was, pa.int32()), pa.array(owner != was)]
                yield pa.RecordBatch.from_arrays(cells, names=["id", "v", "owner", "distance", "was", "moved"])

    return run


def _transfers(size: int, clusters: int):
    """A task's signed sums: what moved vectors bring to and take from each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, size + 1), np.int64)
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)
            x = np.concatenate((x, np.ones((len(x), 1), np.int64)), 1)
            for name, sign in (("owner", 1), ("was", -1)):
                at = batch.column(name).to_numpy(zero_copy_only=False)
                np.add.at(total, at[at >= 0], sign * x[at >= 0])
        cluster, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(total[cluster, place])], names=["cluster", "place", "n"])

    return run


def transferred(assigned: DataFrame, clusters: int, size: int) -> np.ndarray:
    """Changes of sums (and, last, of sizes) by centroid; only moved vectors are read."""
    out = np.zeros((clusters, size + 1), object)
    moved = assigned.where("moved").select("v", "owner", "was").mapInArrow(_transfers(size, clusters), "cluster int, place int, n long")
    for r in moved.groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        out[r["cluster"], r["place"]] = int(r["n"])
    return out


def moved_centroids(centroids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Floored means; a centroid without vectors stays."""
    out = centroids.copy()
    for k, row in enumerate(sums):
        if row[-1]:
            out[k] = [int(s) // int(row[-1]) for s in row[:-1]]
    return out


def cluster(vectors: DataFrame, id_column: str = "vec_id", size: int = SIZE, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """``id, owner, distance`` of every vector after so many rounds and a last assignment, and
    the centroids."""
    rows = prepared(vectors, id_column, size, scale)
    centroids = first_centroids(rows, clusters, seed)
    clusters = len(centroids)
    changed = np.ones(clusters, bool)
    sums = np.zeros((clusters, size + 1), object)
    none = F.lit(-1)
    held = rows.select("id", "v", none.alias("owner"), none.cast("long").alias("distance"))
    if not clusters:
        return held.select("id", "owner", "distance"), centroids
    before = None
    for k in range(rounds + 1):
        held = keep(held.select("id", "v", "owner", "distance").mapInArrow(_round(size, centroids, changed), _OUT), "lloyd", by="moved")
        if before is not None:
            discard(before)
        before = held
        if k < rounds:
            sums = sums + transferred(held, clusters, size)
            after = moved_centroids(centroids, sums)
            changed, centroids = (after != centroids).any(1), after
            if not changed.any():
                break  # no later round could change anything
    return held.select("id", "owner", "distance"), centroids


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    spark = assigned.sparkSession
    texts = [(k, ",".join(str(int(c)) for c in row)) for k, row in enumerate(centroids)]
    digests = spark.createDataFrame(texts, "owner int, text string").select("owner", F.sha2(F.col("text").cast("binary"), 256).alias("centroid_sha256"))
    sums = {r["owner"]: int(r["n"]) for r in assigned.groupBy("owner").agg(F.sum("distance").alias("n")).collect()}
    inertia = spark.createDataFrame([(k, n, sum(sums.values())) for k, n in sums.items()], "owner int, cluster_inertia long, inertia long")
    told = F.broadcast(digests.join(inertia, "owner"))  # a row a centroid
    return assigned.join(told, "owner").select(F.col("id").alias("vec_id"), F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def fit(vectors: DataFrame) -> DataFrame:
    return report(*cluster(vectors))
