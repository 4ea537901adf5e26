"""Substring dedup by level-wise doubling of repeated windows.

A text's words lose those that lie in a window of ``2 ** k * base`` words whose word
sequence also starts in a document with a smaller id.

Level 0 looks for runs of ``base`` words held by two different texts. Not every run
needs a look: each window of ``2 * base`` words is represented by the run inside it
whose hash is least (the leftmost of equals). Equal windows have equal
representatives, so nothing is lost, and about one run in ``base / 2`` is compared.
Level 1 extends the repeated runs alone to the windows of twice the length that
they represent; level ``k + 1`` extends what level ``k`` found repeated, until the
asked length is reached or no candidate survives.

Between levels only hashes and positions are shuffled, and of the texts those that
hold survivors; hot runs are counted by a partial aggregation and joined back, so
that no group of copies is gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, meeting, written
from .words import Words, rolling, sliced, text_column

#: Another odd multiplier, so that windows and runs are hashed independently.
OTHER_BASE = 0xD6E8FEB86659FD93


def least_runs(runs: np.ndarray, window: int, run: int) -> np.ndarray:
    """For each window of ``window`` words, the position of its least run of ``run`` words (leftmost of equals)."""
    span = window - run + 1
    if len(runs) < span:
        return np.zeros(0, np.int64)
    # The least of each span by doubling: two spans of a power of two that overlap.
    at, have = np.arange(len(runs)), 1
    while have * 2 <= span:
        a, b = at[:-have], at[have:]
        at, have = np.where(runs[b] < runs[a], b, a), have * 2
    n = len(runs) - span + 1
    a, b = at[:n], at[span - have :][:n]
    return np.where(runs[b] < runs[a], b, a)


def _per_text(words: Words):
    """(index, word hashes) of each text."""
    hashes = words.hashes()
    for i in range(len(words.bounds) - 1):
        yield i, hashes[words.bounds[i] : words.bounds[i + 1]]


def _sequence_hash(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _runs(base: int, window: int):
    """(run, value, doc_id, place) of the runs to compare: the value tells texts apart.

    One more row for each text, at place -1, has the whole text's hash for a run and
    the document for a value, so that one aggregation also finds the whole copies.
    """

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            ids, words = part.column(0).to_numpy(), Words(part.column(1))
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, hashes in _per_text(words):
                if len(hashes) < window:
                    continue
                runs, whole = rolling(hashes, base), _sequence_hash(hashes)
                at = np.unique(least_runs(runs, window, base))
                out[0].append(np.append(runs[at].view(np.int64), whole))
                out[1].append(np.append(np.full(len(at), whole), ids[i]))
                out[2].append(np.full(len(at) + 1, ids[i]))
                out[3].append(np.append(at, -1).astype(np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["run", "value", "doc_id", "place"])

    return over


def _windows(base: int, window: int):
    """The windows whose least run is among the text's repeated runs."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            ids, words, places = part.column(0).to_numpy(), Words(part.column(1)), part.column(2)
            docs, keys, starts = [], [], []
            for i, hashes in _per_text(words):
                if len(hashes) < window or not len(places[i]):
                    continue
                kept = np.zeros(len(hashes), bool)
                own = places[i].values.to_numpy()
                kept[own[own < len(hashes)]] = True
                at = np.flatnonzero(kept[least_runs(rolling(hashes, base), window, base)])
                docs.append(np.full(len(at), ids[i]))
                keys.append(rolling(hashes, window, OTHER_BASE)[at].view(np.int64))
                starts.append(at.astype(np.int32))
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, docs, starts)], names=["window", "doc_id", "start"])

    return over


def _cut(window: int):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            texts = part.column(1)
            words = Words(texts)
            n_words = words.counts()
            copies, starts = part.column(2), part.column(3)
            removed, digests, texts_out = [], [], []
            for i in range(part.num_rows):
                own = words.codes[words.bounds[i] : words.bounds[i + 1]]
                gone = np.zeros(len(own) + 1, np.int64)
                if copies[i].as_py() and len(own) >= window:
                    gone[0] = 1
                elif starts[i].is_valid:
                    at = starts[i].values.to_numpy()
                    at = at[at + window <= len(own)]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                stays = np.cumsum(gone)[:-1] == 0
                left = b" ".join(words.unique.take(pa.array(own[stays])).to_pylist())
                removed.append(len(own) - int(stays.sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                texts_out.append(left.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts_out, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return over


def repeated_windows(docs: DataFrame, base: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """(window starts to remove by document, whole copies): what the levels find.

    ``docs`` has doc_id and text. A document that is a word-for-word copy of one
    with a smaller id needs no search: all of it is repeated.
    """
    window = base * 2
    # Both are tables, so that the join has a shuffle of its own for each and adaptive execution can split a hot run.
    runs = written(docs.mapInArrow(_runs(base, window), "run long, value long, doc_id long, place int"), "runs")
    repeated = written(runs.groupBy("run").agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low <> high").select("run", "low"), "repeated-runs")
    places = written(runs.join(repeated, "run").where("place >= 0 or doc_id > low").select("doc_id", "place"), "places")
    forget(runs, repeated)
    copies = written(places.where("place < 0").select("doc_id").distinct(), "copies")
    places = places.where("place >= 0").join(copies, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    places = written(places, "places")
    found = meeting(docs, places, "doc_id").select("doc_id", "text", "places").mapInArrow(_windows(base, window), "window long, doc_id long, start int")
    for level in range(1, levels + 1):
        found = written(found, "windows")
        firsts = found.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
        if level == levels:
            found = found.join(firsts, "window").where("doc_id > first").select("doc_id", "start")
            break
        # Two adjacent windows of one length are a window of twice the length; both must be repeated.
        alive = found.join(firsts.select("window"), "window", "left_semi")
        behind = alive.select("doc_id", (F.col("start") - base * 2**level).alias("start"), F.col("window").alias("behind"))
        found = alive.join(behind, ["doc_id", "start"]).select(F.xxhash64("window", "behind").alias("window"), "doc_id", "start")
    return found, copies


def substring_dedup(docs: DataFrame, *, base: int = 25, levels: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: words, removed words, and the words kept, joined by single spaces.

    Windows have ``base * 2 ** levels`` words. Null texts have no words; texts shorter
    than a window lose nothing. Among exact copies the smallest id keeps its words. Rows
    that share an id are one document: none removes from another, and each loses the
    words at the same starts. Rows without an id stay whole and remove nothing elsewhere. Texts of any length are read whole.
    Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    read = text_column(docs, id_col, text_col)
    starts, copies = repeated_windows(read.where("doc_id is not null"), base, levels)
    starts = starts.groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    none = F.lit(None).cast("array<int>")
    marks = starts.select("doc_id", F.lit(False).alias("copy"), "starts").unionByName(copies.select("doc_id", F.lit(True).alias("copy"), none.alias("starts")))
    marks = written(marks, "marks")
    columns = ["doc_id", "text", "copy", "starts"]
    cut = meeting(read, marks, "doc_id").select(columns)
    whole = meeting(read, marks, "doc_id", how="left_anti").select("doc_id", "text", F.lit(False).alias("copy"), none.alias("starts"))
    return cut.unionByName(whole).mapInArrow(_cut(base * 2**levels), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
