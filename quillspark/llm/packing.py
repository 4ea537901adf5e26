"""Best-fit packing of documents into token sequences, with vector capacities.

A piece asks for a vector of tokens, one document and its attention cost (length
squared). An open sequence has what is left of each. Pieces go, longest first, to
the sequence that fits them under every constraint and scores best: by the smallest
weighted norm of what would be left, or by the largest weighted dot product of the
piece with what is left.

Texts are tokenised once, without a shuffle; the pieces (a few integers each) are
written, dealt at random to shards of about ``shard_pieces``, and each shard is
packed on its own. Sequences that a shard leaves open are at most one or two in
about a thousand, whatever the size of the corpus.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .tokens import text_ids
from .words import per_slice, text_column

#: Text in a slice: a slice holds the ids of its words, and Python objects for the distinct ones.
SLICE_BYTES = 2 << 20
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES.replace("row long, ", "") + ", sequence_id long, offset long"


def pieces(docs: DataFrame, vocabulary: str, *, max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each text's ids plus ``end_id``; only texts over ``max_tokens`` are cut."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = text_ids(vocabulary, part.column(1))
        doc_ids, rows = part.column(0).to_pylist(), part.column(2).to_pylist()
        out: list[tuple] = []
        for i, (doc, row) in enumerate(zip(doc_ids, rows, strict=True)):
            own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
            for k, start in enumerate(range(0, len(own), max_tokens)):
                cut = own[start : start + max_tokens]
                out.append((doc, row, k, start, len(cut), zlib.crc32(cut.tobytes())))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    read = text_column(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return read.mapInArrow(per_slice(run, limit=SLICE_BYTES), PIECES)


def vector_best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, int]:
    """The bin of each row of ``demand``, in the order given, and the number of bins.

    A row that alone exceeds a capacity gets a bin of its own.
    """
    need = demand / capacity
    left = np.ones((max(len(need), 1), need.shape[1]))
    slack, used = 1e-12, 0
    bins = np.zeros(len(need), np.int64)
    for i, x in enumerate(need):
        room = left[:used] - x
        fits = np.flatnonzero((room >= -slack).all(1))
        if len(fits):
            if rule == "norm":
                score = -((room[fits] ** 2) @ weights)
            elif rule == "dot":
                score = left[fits] @ (weights * x)
            else:
                raise ValueError(f"rule must be norm or dot, not {rule!r}")
            best = fits[np.argmax(score)]
        else:
            best, used = used, used + 1
        left[best] -= x
        bins[i] = best
    return bins, used


def best_fit_packing(
    docs: DataFrame,
    vocabulary: str,
    *,
    max_tokens: int = 2048,
    max_documents: int | None = None,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02),
    rule: str = "norm",
    shard_pieces: int = 4096,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece with its sequence and its place there.

    ``max_documents`` and ``max_attention`` default to what ``max_tokens`` implies
    (a token each, and one full-length piece), so that by themselves they cost no
    sequence. Null and empty texts are the single id ``end_id``. Repeated rows are
    packed each on their own, rows without an id too. An empty table gives an empty result. Ties go to the
    longer piece, then the lower document id, piece and row. Texts of any length are cut whole. Other columns,
    whatever their names, are not read.
    """
    capacity = np.array([max_tokens, max_documents or max_tokens, max_attention or float(max_tokens) ** 2], float)
    cut = written(pieces(docs, vocabulary, max_tokens=max_tokens, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    open_pieces = cut.where(F.col("length") < max_tokens)
    shards = max(1, math.ceil(open_pieces.count() / shard_pieces))
    full = cut.where(F.col("length") == max_tokens)

    def pack(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], ignore_index=True)
        length = own["length"].to_numpy(float)
        bins, _ = vector_best_fit(np.stack([length, np.ones_like(length), length**2], 1), capacity, np.array(weights), rule)
        own["sequence_id"] = bins * 2 * shards + int(key[0])
        own["offset"] = own.groupby("sequence_id")["length"].cumsum() - own["length"]
        return own[[x.split()[0] for x in PACKED.split(", ")]]

    # Rows without an id have shards of their own: beside them pandas would hold ids as floating point.
    shard = F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(shards)) + F.when(F.col("doc_id").isNull(), shards).otherwise(0)
    packed = open_pieces.groupBy(shard.alias("shard")).applyInPandas(pack, PACKED)
    # Full-length pieces are sequences of their own, with negative ids.
    alone = full.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
