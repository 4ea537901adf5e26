"""Word splitting, dictionary coding and rolling hashes on Arrow text columns.

A word is a maximal run of characters outside ``\\x20`` and ``\\x09-\\x0D``.
Everything here works on one Arrow slice inside a Spark task; a null text has no
words. Slices hold a bounded number of bytes, or one text if it alone is longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .worker import release

SLICE_BYTES = 4 << 20
#: Odd multiplier of the rolling hashes (the 64-bit golden ratio).
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def text_column(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, under fixed names, so that others can't clash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more
    )


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(byte_lengths(batch.column(batch.schema.get_field_index(column))))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(_offsets(texts)) if len(texts) else np.zeros(0, np.int64)


class Words:
    """The words of a column of texts.

    ``codes[bounds[i]:bounds[i + 1]]`` are the words of text ``i`` as indexes into
    ``unique``, the distinct words in order of first appearance.
    """

    def __init__(self, texts: pa.Array, lower_ascii: bool = False):
        offsets = _offsets(texts)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if texts.null_count:  # what a null slot covers is undefined
            raw = raw.copy()
            for i in np.flatnonzero(np.asarray(texts.is_null())):
                raw[offsets[i] : offsets[i + 1]] = 32
        if lower_ascii:
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(starts, offsets)
        lengths = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
        plain = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(lengths), pa.py_buffer(raw[inside])])
        coded = plain.dictionary_encode()
        self.codes = np.asarray(coded.indices)
        self.unique = coded.dictionary

    def __len__(self) -> int:
        return len(self.codes)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """The text index of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every slice."""
        one = xxhash.xxh3_64_intdigest
        return np.fromiter((one(w) for w in self.unique.to_pylist()), np.uint64, len(self.unique))[self.codes]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of powers spread over all bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Hash of each run of ``width`` values; shorter by ``width - 1`` than the input."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    # Doubling: a window of 2w values is two windows of w, so log(width) passes are enough.
    done, total, at, block, span = None, 0, 0, hashes.astype(np.uint64), 1
    n = len(hashes) - width + 1
    while True:
        if width >> at & 1:
            if done is None:
                done = block[:n].copy() if span == width else block.copy()
            else:
                done = done[: len(block) - total] * np.uint64(pow(base, span, 1 << 64)) + block[total : total + len(done)][: len(block) - total]
            total += span
        if span * 2 > width:
            return mixed(done[:n])
        block = block[:-span] * np.uint64(pow(base, span, 1 << 64)) + block[span:]
        span, at = span * 2, at + 1


def windows_inside(counts: np.ndarray, width: int) -> np.ndarray:
    """Positions, among all words, at which a window lies within one text."""
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(len(ends))
    return at[at + width <= ends]


def per_slice(run: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", limit: int = SLICE_BYTES):
    """A function for mapInArrow that applies ``run`` to each bounded slice."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in sliced(batches, column, limit):
            out = run(part)
            if out is not None and out.num_rows:
                yield out
        part = out = None
        release()

    return over
