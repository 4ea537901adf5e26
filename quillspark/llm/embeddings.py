"""Embedding near-dedup by sorted projection passes and blocks against blocks.

In each pass every vector gets a number of sign bits of random projections, drawn
anew; the vectors of a label are ordered by them, and each is compared with a bounded
window of its followers. Verified pairs of all passes are united into groups.
Windows can miss links in dense groups, so then every vector meets every other of its
label and width, in blocks that never meet more than one other block at a time: a label
of any size is spread over as many tasks as it has pairs of blocks. A task counts the
links of its vectors, and returns only links between groups that are still apart, of
those a spanning forest. So the result is exact, and the passes only save links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, written

KEY_BITS = 62


def _planes(seed: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, KEY_BITS))


def _rows(column: pa.Array) -> np.ndarray:
    """Lists of one length as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _units(rows: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that squares of any finite vector neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _keyed(passes: int, seed: int):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.asarray(batch.column(3))
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                vectors = _units(_rows(part.column(2)))
                for k in range(passes):
                    bits = vectors @ _planes(seed + k, int(width)) > 0
                    key = bits @ (np.int64(1) << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), k, np.int32)), part.column(1), part.column(3), pa.array(key), part.column(0), part.column(2)],
                        names=["pass", "label", "width", "key", "vec_id", "embedding"],
                    )

    return over


def _find(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _windowed(window: int, threshold: float):
    """Verified pairs of neighbours in the order of one partition. Of those, a spanning forest is enough."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.RecordBatch | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                old = before.num_rows if before is not None else 0
                both = pa.Table.from_batches([before, part] if old else [part]).combine_chunks().to_batches()[0]
                group = np.stack([both.column(i).to_numpy() for i in (0, 1, 2)], 1)
                ids = both.column(4).to_numpy()
                parent: dict[int, int] = {}
                links: list[tuple[int, int]] = []
                starts = np.r_[0, np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1, len(ids)]
                for a, b in zip(starts, starts[1:], strict=False):
                    if b - a < 2 or b <= old:
                        continue
                    units = _units(_rows(both.column(5).slice(a, b - a)))
                    for low in range(0, b - a, 256):
                        own, other = units[low : low + 256], units[low : low + 256 + window]
                        i, j = np.nonzero(own @ other.T >= threshold)
                        near = (j > i) & (j <= i + window) & (a + low + j >= old)
                        for x, y in zip(ids[a + low + i[near]].tolist(), ids[a + low + j[near]].tolist(), strict=True):
                            u, v = _find(parent, x), _find(parent, y)
                            if u != v:
                                parent[u] = v
                                links.append((x, y))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["u", "v"])
                before = both.slice(max(0, both.num_rows - window))

    return over


#: Rows of a product that are held at once.
TILE = 1024


def _counted(threshold: float):
    """Links of each vector (n) to other vectors, ``times`` for each that stands for several, in one pair of blocks, and links between components not yet united (u, v with n = 0)."""

    def count(own: pd.DataFrame) -> pd.DataFrame:
        side, ids, groups, times = own["side"].to_numpy(), own["vec_id"].to_numpy(), own["component"].to_numpy(), own["times"].to_numpy()
        units = _units(np.stack(own["embedding"].to_numpy()).astype(np.float64))
        alone = own["low"].iat[0] == own["high"].iat[0]
        left = np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side == 1)
        n, parent, links = np.zeros(len(own), np.int64), {}, []
        for at in range(0, len(left), TILE):
            rows = left[at : at + TILE]
            near = units[rows] @ units[right].T >= threshold
            if alone:
                near[np.arange(len(rows)), at + np.arange(len(rows))] = False
            else:
                n[right] += times[rows] @ near
            n[rows] += near @ times[right]
            i, j = np.nonzero(near & (groups[rows][:, None] != groups[right][None, :]))
            apart = np.unique(np.stack([groups[rows[i]], groups[right[j]]], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
            for x, y in apart.tolist():
                u, v = _find(parent, x), _find(parent, y)
                if u != v:
                    parent[u] = v
                    links.append((x, y))
        u, v = (np.array(x, np.int64) for x in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"u": np.r_[ids, u], "v": np.r_[ids, v], "n": np.r_[n, np.zeros(len(u), np.int64)]})

    return count


def embedding_dedup(vectors: DataFrame, *, threshold: float = 0.98, passes: int = 12, window: int = 64, block: int = 256, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null labels and equal widths are compared, by cosine in
    double precision; a cosine of the threshold itself links. Vectors that are null, empty, zero, or hold null, NaN
    or infinite components link with nothing, and are kept, as are rows without an id, whose component is null.
    Rows that repeat an id are one vector, the least by label and components if they differ, and
    give repeated rows. Vectors of any magnitude and width are taken whole. Other columns, whatever their names,
    are not read. An empty table gives an empty result. Equal vectors, told by 128 bits of hashes, are compared once.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    whole = vectors.schema[label_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    label = F.col(label_col).cast("long") if whole else F.xxhash64(label_col)
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(label_col).isNotNull().alias("labelled"), F.col(vector_col).cast(kind).alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = read.where("vec_id is not null and labelled and size(embedding) > 0").where(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    usable = usable.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.*")
    usable = usable.select("*", F.size("embedding").alias("width"), F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "label", "embedding").alias("h2"))
    # Equal vectors: the least stands for all of them.
    classes = usable.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "label", "width", "embedding")).alias("v"), F.count("*").alias("times")).select("h1", "h2", "v.*", "times")
    classes = written(classes, "vector-classes")
    keyed = classes.select("vec_id", "label", "embedding", "width").mapInArrow(_keyed(passes, seed), f"pass int, label long, width int, key long, vec_id long, embedding {kind}")
    order = ["pass", "label", "width", "key", "vec_id"]
    links = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_windowed(window, threshold), "u long, v long")
    groups = written(components(links, what="vector-components"), "vector-groups")
    # Labels of many vectors have larger blocks, so that each vector is sent a number of times that grows with the root.
    number_of = F.ceil(F.least(F.count("*") / F.lit(block), F.greatest(F.lit(16), F.sqrt(F.count("*")) / 4))).cast("int")
    sizes = classes.groupBy("label", "width").agg(number_of.alias("blocks"))
    members = classes.join(sizes, ["label", "width"]).join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left").withColumn("component", F.coalesce("component", "vec_id"))
    members = members.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    # Block i meets each block j >= i once: as side 0 where it is the lower, as side 1 where it is the higher.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("low"), F.greatest("own", j).alias("high"), (F.col("own") > j).cast("int").alias("side")))
    dealt = members.select("vec_id", "label", "width", "component", "times", "embedding", F.explode(meets).alias("m")).select("vec_id", "label", "width", "component", "times", "embedding", "m.*")
    met = written(dealt.groupBy("label", "width", "low", "high").applyInPandas(_counted(threshold), "u long, v long, n long"), "vector-counts")
    counts = met.where("u = v").groupBy(F.col("u").alias("vec_id")).agg(F.sum("n").alias("n"))
    # Groups that the windows left apart: their least ids are linked, and lead on to the least of all.
    led = written(components(met.where("u <> v").select("u", "v"), what="vector-joins"), "vector-leads").select(F.col("node").alias("component_id"), F.col("component").alias("led"))
    found = classes.select("h1", "h2", "vec_id", "times").join(groups.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left").select("h1", "h2", "vec_id", "times", F.coalesce("component", "vec_id").alias("component_id"))
    found = found.join(led, "component_id", "left").join(counts, "vec_id").select("h1", "h2", F.coalesce("led", "component_id").alias("component_id"), (F.col("n") + F.col("times") - 1).alias("n_links"))
    found = written(found, "vector-links")
    of_each = usable.select("vec_id", "h1", "h2").join(found, ["h1", "h2"]).select("vec_id", "component_id", "n_links")
    return (
        read.select("vec_id")
        .join(of_each, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
