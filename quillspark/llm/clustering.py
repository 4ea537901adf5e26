"""Centroid clustering by scalar lookup tables.

Vectors become integers, so centroids, distances and sums are exact and come out the same in any
order. In a round every slice tabulates, for each dimension, the squared difference of each integer that occurs in it
to each centroid. A vector's distances are then gathered from the tables and summed over the dimensions; no
difference is computed twice for the same integer. A task sends one sum a cluster and dimension.

The integers are written once, narrow, and read in each round. The driver holds the centroids, whose
number and width are parameters, and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written

#: Larger integers could make a squared distance of 64 components pass 64 bits.
LARGEST = 1 << 27
SLICE_ROWS = 4096


def squared_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(rows x centroids): for each dimension a table of the integers that occur, gathered by the rows and summed."""
    out = np.zeros((len(rows), len(centroids)), np.int64)
    for d in range(rows.shape[1]):
        occurring, place = np.unique(rows[:, d], return_inverse=True)
        table = (occurring[:, None] - centroids[None, :, d]) ** 2
        out += table[place]
    return out


def _integers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _summed(centroids: np.ndarray):
    """(cluster, dim, total, n) of a task's vectors; dim -1 holds their number."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        sums, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for part in _slices(batches):
            rows = _integers(part.column(1), width)
            own = squared_distances(rows, centroids).argmin(1)
            order = np.argsort(own, kind="stable")
            found, starts = np.unique(own[order], return_index=True)
            sums[found] += np.add.reduceat(rows[order], starts, axis=0)
            n += np.bincount(own, minlength=k)
        for c in np.flatnonzero(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width, c, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(sums[c]), pa.array(np.full(width, n[c]))], names=["cluster", "dim", "total", "n"])

    return over


def _assigned(centroids: np.ndarray):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            distances = squared_distances(_integers(part.column(1), centroids.shape[1]), centroids)
            own = distances.argmin(1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.astype(np.int32)), pa.array(distances[np.arange(len(own)), own])], names=["vec_id", "cluster", "distance"])

    return over


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: of non-empty clusters the exact floor of each component's mean."""
    sums = rows.mapInArrow(_summed(centroids), "cluster int, dim int, total long, n long").groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # as many rows as the centroids have components
        out[r.cluster, r.dim] = r.total // r.n
    return out


def centroid_clustering(vectors: DataFrame, *, clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``width`` components, none null, NaN or infinite. A component x becomes
    floor(``scale`` * x); a vector with an integer beyond 2^27 either way, whose distance a long might not hold, is left
    out too. Centroids start as the vectors whose ``seed:id`` has the least SHA-256, in that order, equal ones by their
    integers; fewer vectors than ``clusters`` give as many centroids as there are. Equal distances go to the lower number, empty
    clusters keep their centroid. Rows that repeat an id are vectors of their own, each with its row and its weight. Rows without an
    id are assigned and count in the means, but no centroid starts as one. Sums of distances that pass a
    long are null. Other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x * scale).cast("double")) <= LARGEST) & (F.abs(x) <= LARGEST))
    kept = read.where((F.size("v") == width) & usable).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("v"))
    kept = written(kept, "integers")
    first = kept.where("vec_id is not null").withColumn("key", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy("key", "v").select("v").limit(clusters)
    centroids = np.array([r.v for r in first.collect()], np.int64).reshape(-1, width)
    spark = vectors.sparkSession
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        after = moved(kept, centroids)
        if (after == centroids).all():
            break
        centroids = after
    found = written(kept.mapInArrow(_assigned(centroids), schema), "assigned")
    forget(kept)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    fits = lambda x: x if x < 1 << 63 else None
    whole = fits(sum(int(r.s) for r in sums))
    told = [(r.cluster, fits(int(r.s)), whole, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in sums]
    of_each = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
