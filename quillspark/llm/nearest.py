"""Approximate nearest neighbours by an inverted multi-index.

Vectors of length one are cut in two halves, and each half is quantised by centroids of its own. A pair of
centroids is a cell with a list of the vectors whose halves they are nearest to: with K centroids a half there are K * K cells. A query
orders both halves' centroids by distance, and a heap over the grid of pairs gives the cells in the order of the
summed distances. The vectors of the first cells are reranked by their cosine.

How many cells a query visits is measured, not guessed: the neighbours of a bounded sample are found by comparing it
with every row, and the depth is the least at which the asked share of them is visited.

Every row is indexed. Lists are dealt to blocks of a bounded size, in the order of the cells: small cells share one, a cell that
holds a third of all rows has many. Queries are dealt to blocks by their nearest cell, so that those of one block visit the same lists, and
a block of lists is sent only to the blocks of queries that visit it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .embeddings import _rows, _units
from .shared import written

#: Vectors a cell holds on average, and the most centroids a half may have.
PER_CELL, MOST_CENTROIDS = 64, 1024
#: Vectors that centroids are fitted to, for each of them; at most MOST_CENTROIDS times as many.
FIT_ROWS = 64
#: Vectors whose neighbours are looked for among all rows to set the depth.
CALIBRATED = 256
SLICE_ROWS = 2048


def centroids_of(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """``k`` means (Lloyd's rounds); centroids start as rows spread over the sample, and empty ones stay."""
    found = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = ((found * found).sum(1) - 2 * rows @ found.T).argmin(1)
        order = np.argsort(own, kind="stable")
        some, starts, n = np.unique(own[order], return_index=True, return_counts=True)
        found[some] = np.add.reduceat(rows[order], starts, axis=0) / n[:, None]
    return found


@dataclass(frozen=True)
class Index:
    """The centroids of both halves, and how many vectors each cell (first * K + second) holds."""

    halves: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray | None = None

    def distances(self, units: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each half to its centroids, less what is the same for all of them."""
        cut = units.shape[1] // 2
        return [(c * c).sum(1) - 2 * half @ c.T for c, half in zip(self.halves, (units[:, :cut], units[:, cut:]), strict=True)]

    def cells(self, units: np.ndarray) -> np.ndarray:
        first, second = (d.argmin(1) for d in self.distances(units))
        return first * len(self.halves[1]) + second

    def visited(self, first: np.ndarray, second: np.ndarray) -> Iterator[int]:
        """The cells that hold vectors, by summed distance to one query's halves."""
        rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        a, b, names, others = first[rows].tolist(), second[columns].tolist(), (rows * len(second)).tolist(), columns.tolist()
        heap = [(a[0] + b[0], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if not j and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            cell = names[i] + others[j]
            if self.counts[cell]:
                yield cell


def fitted(sample: np.ndarray, n: int) -> Index:
    """Centroids for ``n`` vectors, fitted to a sample of them."""
    k = int(min(MOST_CENTROIDS, len(sample), max(1, round((n / PER_CELL) ** 0.5))))
    cut = sample.shape[1] // 2
    return Index((centroids_of(sample[:, :cut], k), centroids_of(sample[:, cut:], k)))


def nearest_rows(ids: np.ndarray, units: np.ndarray, others: np.ndarray, other_units: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of each query's ``k`` nearest other vectors, equal scores to the lower id.

    A product finds who may be among them; their scores are then summed one by one in one order, so that equal vectors score equally
    wherever they stand.
    """
    rough = units @ other_units.T
    rough[ids[:, None] == others[None, :]] = -np.inf
    if allowed is not None:
        rough[~allowed] = -np.inf
    most = min(k, rough.shape[1])
    least = np.partition(rough, rough.shape[1] - most, axis=1)[:, rough.shape[1] - most]
    i, j = np.nonzero((rough >= least[:, None] - 1e-12) & np.isfinite(rough))
    score = np.concatenate([(units[i[a : a + 65536]] * other_units[j[a : a + 65536]]).sum(1) for a in range(0, len(i), 65536)] or [np.zeros(0)])
    order = np.lexsort((others[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    own = rank < k
    return i[own], others[j[own]], score[own]


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _celled(index: Index):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(index.cells(_units(_rows(part.column(1)))))], names=["vec_id", "embedding", "cell"])

    return over


def _compared(ids: np.ndarray, units: np.ndarray, k: int):
    """(query, vec_id, cell, score): of all that a task reads, the nearest to each of a few queries."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, v, cell, score = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float))
        for part in _slices(batches):
            own, cells = part.column(0).to_numpy(), part.column(2).to_numpy()
            i, near, s = nearest_rows(ids, units, own, _units(_rows(part.column(1))), k)
            of = dict(zip(own.tolist(), cells.tolist(), strict=True))
            q, v, score = np.r_[q, i], np.r_[v, near], np.r_[score, s]
            cell = np.r_[cell, [of[x] for x in near.tolist()]].astype(np.int64)
            order = np.lexsort((v, -score, q))
            q, v, cell, score = q[order], v[order], cell[order], score[order]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, v, cell, score = q[best], v[best], cell[best], score[best]
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q, v, cell, score)], names=["query", "vec_id", "cell", "score"])

    return over


def depth_for(index: Index, entries: DataFrame, sample: list, k: int, recall: float) -> int:
    """The least number of cells that holds ``recall`` of the sampled vectors' true neighbours."""
    ids, units = np.array([r.vec_id for r in sample], np.int64), _units(np.array([r.embedding for r in sample], np.float64))
    near = entries.mapInArrow(_compared(ids, units, k), "query long, vec_id long, cell long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    wanted: dict[int, list[int]] = {}
    for r in near.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "cell").collect():  # k rows for each of the sample
        wanted.setdefault(r.query, []).append(r.cell)
    first, second = index.distances(units)
    depths: list[int] = []
    for query, cells in wanted.items():
        left = sorted(cells)
        for at, cell in enumerate(index.visited(first[query], second[query]), 1):
            while cell in left:
                left.remove(cell)
                depths.append(at)
            if not left:
                break
    depths.sort()
    return depths[min(len(depths) - 1, int(np.ceil(recall * len(depths))))] if depths else 1


def dealt(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell: cells in order share blocks of about ``size``, a larger cell has several of its own."""
    parts = np.maximum(1, -(-counts // size))
    alone = parts > 1
    # A run of small cells ends where a large one stands; what they hold before it, in blocks, numbers them.
    small = np.where(alone, 0, counts)
    run = np.cumsum(alone)
    start = np.r_[0, np.cumsum(small)][:-1]
    base = start[np.searchsorted(run, run)]
    key = np.stack([run, np.where(alone, -1, (start - base) // size)], 1)
    new = np.r_[True, (key[1:] != key[:-1]).any(1)]
    width = np.where(new, parts, 0)
    first = np.cumsum(width) - width
    return np.maximum.accumulate(np.where(new, first, 0)), parts


def _probes(index: Index, depth: int, k: int, blocks: tuple[np.ndarray, np.ndarray]):
    """(query_id, embedding, cell, block, cells): for each block that holds a visited cell, the visited cells in it. ``cell`` is the query's nearest."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, parts = blocks
        for part in _slices(batches):
            ids, vectors = part.column(0), part.column(1)
            first, second = index.distances(_units(_rows(vectors)))
            own, nearest, block, lists = [], [], [], []
            for i in range(part.num_rows):
                some, held = [], 0
                for at, cell in enumerate(index.visited(first[i], second[i]), 1):
                    some.append(cell)
                    held += index.counts[cell]
                    if at >= depth and held > k:
                        break
                cells = np.sort(np.array(some, np.int64))
                to = np.repeat(starts[cells], parts[cells]) + np.arange(parts[cells].sum()) - np.repeat(np.cumsum(parts[cells]) - parts[cells], parts[cells])
                cells = np.repeat(cells, parts[cells])
                names, at = np.unique(to, return_index=True)
                for b, c in zip(names.tolist(), np.split(cells, at[1:]), strict=True):
                    own.append(i)
                    nearest.append(some[0])
                    block.append(b)
                    lists.append(c)
            ends = np.r_[0, np.cumsum([len(c) for c in lists])].astype(np.int32)
            for a in range(0, len(own), SLICE_ROWS):
                b = min(len(own), a + SLICE_ROWS)
                cut = pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - ends[a]), pa.array(np.concatenate(lists[a:b])))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[a:b])), vectors.take(pa.array(own[a:b])), pa.array(nearest[a:b], pa.int64()), pa.array(block[a:b], pa.int64()), cut], names=["query_id", "embedding", "near", "block", "cells"])

    return over


def _reranked(k: int):
    """The ``k`` nearest vectors of each query of one block of queries, in the lists of one block."""

    def both(queries: pa.Table, entries: pa.Table) -> pa.Table:
        queries, entries = (t.combine_chunks() for t in (queries, entries))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and entries.num_rows:
            ids, cells = (entries.column(c).combine_chunks().to_numpy() for c in ("vec_id", "cell"))
            units = _units(_rows(entries.column("embedding").combine_chunks()))
            for at in range(0, queries.num_rows, 256):
                part = queries.slice(at, 256).combine_chunks()
                own = part.column("query_id").combine_chunks().to_numpy()
                lists = part.column("cells").combine_chunks()
                known, place = np.unique(cells, return_inverse=True)
                asked = np.zeros((len(own), len(known)), bool)
                flat, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(own)), lists.value_lengths().to_numpy())
                where = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                met = known[where] == flat  # a cell's part may hold none of its vectors
                asked[of[met], where[met]] = True
                i, near, score = nearest_rows(own, _units(_rows(part.column("embedding").combine_chunks())), ids, units, k, asked[:, place])
                out.append((own[i], near, score))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return both


def approximate_nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, recall: float = 0.96, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest vectors found for each query, by cosine in double precision.

    ``queries`` has the same columns as ``vectors``. A query is not its own neighbour: vectors of its id are left out. Equal
    scores go to the lower id, the first rank is 1. Where fewer than ``k`` others take part, all of them are given. Vectors that are
    null, empty, zero or hold null, NaN or infinite components and rows without an id take no part, on either side. Rows that repeat an id
    are one vector, the least by components. Vectors meet those of their width; each width has an index of its own.
    ``recall`` is the share of true neighbours that the depth of the search is set for, on a sample of 256; centroids are fitted to
    64 vectors for each, 65,536 at most. Other columns, whatever their names, are not read. Without queries or vectors the result is empty.
    """
    found = None
    prepared, asked = (written(_usable(t, id_col, vector_col), what) for t, what in ((vectors, "vectors"), (queries, "queries")))
    for (width,) in sorted(tuple(r) for r in asked.select("width").distinct().collect()):
        own = _searched(prepared.where(F.col("width") == width), asked.where(F.col("width") == width), k, recall, block)
        found = own if found is None else found.union(own)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found


def _usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kind = "array<float>" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    read = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    read = read.where("vec_id is not null and size(embedding) > 0").where(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    return read.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("width", F.size("embedding"))


def _sampled(rows: DataFrame, n: int, most: int, salt: int) -> list:
    """About ``most`` rows, by a hash of their ids; never more."""
    share = min(1.0, most / max(1, n))
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000))).limit(most).collect()


def _searched(vectors: DataFrame, queries: DataFrame, k: int, recall: float, block: int) -> DataFrame:
    spark, n = vectors.sparkSession, vectors.count()
    kind = vectors.schema["embedding"].dataType.simpleString()
    centroids = min(MOST_CENTROIDS, max(1, round((n / PER_CELL) ** 0.5)))
    sample = _sampled(vectors, n, FIT_ROWS * centroids, 1) or vectors.limit(1).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fitted(_units(np.array([r.embedding for r in sample], np.float64)), n)
    entries = written(vectors.select("vec_id", "embedding").mapInArrow(_celled(index), f"vec_id long, embedding {kind}, cell long"), "entries")
    # As many rows as there are cells, MOST_CENTROIDS squared at most.
    counts = np.zeros(len(index.halves[0]) * len(index.halves[1]), np.int64)
    for r in entries.groupBy("cell").count().collect():
        counts[r.cell] = r["count"]
    index = Index(index.halves, counts)
    some = _sampled(vectors.select("vec_id", "embedding"), n, CALIBRATED, 2) or sample[:CALIBRATED]
    depth = depth_for(index, entries, some, k, recall)
    starts, parts = dealt(counts, block)
    probes = queries.select("vec_id", "embedding").mapInArrow(_probes(index, depth, k, (starts, parts)), f"query_id long, embedding {kind}, near long, block long, cells array<long>")
    probes = written(probes, "probes")
    # Queries of one nearest cell stand together; the blocks of queries are made like those of lists.
    asked = np.zeros(len(counts), np.int64)
    for r in probes.select("query_id", "near").distinct().groupBy("near").count().collect():
        asked[r.near] = r["count"]
    places = lambda cells, first, n_of, names: spark.createDataFrame(pa.table([pa.array(np.flatnonzero(cells)), pa.array(first[cells > 0]), pa.array(n_of[cells > 0])], names=names))
    q_first, q_parts = dealt(asked, 512)
    own = probes.join(F.broadcast(places(asked, q_first, q_parts, ["near", "q_first", "q_parts"])), "near")
    own = own.select("query_id", "embedding", "cells", "block", (F.col("q_first") + F.pmod(F.xxhash64("query_id"), "q_parts")).alias("q_block"))
    lists = entries.join(F.broadcast(places(counts, starts, parts, ["cell", "first", "parts"])), "cell")
    lists = lists.select("vec_id", "embedding", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).alias("block"))
    lists = lists.join(own.select("block", "q_block").distinct(), "block").toDF("at", "vec_id", "embedding", "cell", "q_at")
    met = own.groupBy("block", "q_block").cogroup(lists.groupBy("at", "q_at")).applyInArrow(_reranked(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
