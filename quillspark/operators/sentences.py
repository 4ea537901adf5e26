"""Chunks that end where sentences end, measured in the tokens of a vocabulary.

A chunk takes whole sentences as long as they fit; the next one begins with the last sentences of the one before, as many as fit into
the overlap. A sentence that is longer than a chunk alone is cut between words, and a word that is, between tokens' worth of characters. One pass over the
documents, without a shuffle: a text is split once, each sentence measured once, and every task holds one slice of texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import CHUNK_OVERLAP, CHUNK_TOKENS

#: A sentence ends at a full stop, an exclamation or question mark (with quotes or brackets closed behind it) before white space, at an ideographic full stop, or with an empty line.
SENTENCE_END = re.compile(r"""(?<=[.!?…])["'”’»)\]]*\s+|(?<=[。！？])\s*|\s*\n\s*\n\s*""")
SLICE_ROWS = 256

Counter = Callable[[list[str]], list[int]]


def sentences(text: str) -> list[str]:
    """The sentences of a text, each with the white space behind it; joined, they are the text."""
    out, at = [], 0
    for m in SENTENCE_END.finditer(text):
        if m.end() > at and text[at : m.end()].strip():
            out.append(text[at : m.end()])
            at = m.end()
    return [*out, text[at:]] if text[at:].strip() else [*out[:-1], out[-1] + text[at:]] if out else []


def words_counted(texts: list[str]) -> list[int]:
    return [len(t.split()) for t in texts]


@cache
def vocabulary_counted(path: str) -> Counter:
    """Tokens by a public tokenizers file."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    return lambda texts: [len(e.ids) for e in found.encode_batch_fast(texts, add_special_tokens=False)]


def _halved(word: str, size: int, count: Counter) -> list[tuple[str, int]]:
    n = count([word])[0]
    if n <= size or len(word) == 1:
        return [(word, n)]
    return [x for part in (word[: len(word) // 2], word[len(word) // 2 :]) for x in _halved(part, size, count)]


def _cut(sentence: str, size: int, count: Counter) -> list[tuple[str, int]]:
    """A sentence that doesn't fit as pieces of whole words; their tokens are those of the words."""
    words, out, own, n = re.findall(r"^\s+|\S+\s*", sentence), [], "", 0
    for word, k in zip(words, count(words), strict=True):
        for part, m in [(word, k)] if k <= size else _halved(word, size, count):
            if own and n + m > size:
                out.append((own, n))
                own, n = "", 0
            own, n = own + part, n + m
    return [*out, (own, n)]


def chunked(text: str, size: int, overlap: int, count: Counter) -> list[tuple[str, int]]:
    """(chunk, tokens of its pieces) in order."""
    pieces: list[tuple[str, int]] = []
    own = sentences(text)
    for sentence, n in zip(own, count(own), strict=True):
        pieces += [(sentence, n)] if n <= size else _cut(sentence, size, count)
    out, start, at = [], 0, 0
    while at < len(pieces):
        n = sum(k for _, k in pieces[start:at])
        while at < len(pieces) and (at == start or n + pieces[at][1] <= size):
            n += pieces[at][1]
            at += 1
        out.append(("".join(t for t, _ in pieces[start:at]).strip(), n))
        # The next chunk begins with the last pieces that fit the overlap, as far as its first new one fits behind them.
        start, kept = at, 0
        while at < len(pieces) and start and kept + pieces[start - 1][1] <= min(overlap, size - pieces[at][1]):
            start -= 1
            kept += pieces[start][1]
    return out


def sentence_chunks(documents: DataFrame, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, carry: tuple[str, ...] = ("slug",), vocabulary: str | None = None) -> DataFrame:
    """(carried columns, doc_id, chunk_id, n_chunks, n_tokens, text), as ``graph.chunks`` gives, of documents with doc_id and text that aren't blank.

    ``vocabulary`` is a tokenizers file that executors can read; without one, tokens are words. ``n_tokens`` is the sum over a chunk's
    sentences, ``size`` at most.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than a chunk")
    kept = documents.where(~X.is_blank(F.col("text"))).select(F.struct(*carry, "doc_id").alias("of"), F.col("text").cast("string").alias("text"))
    kind = kept.schema["of"].dataType.simpleString()

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = vocabulary_counted(vocabulary) if vocabulary else words_counted
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                own = [chunked(t, size, overlap, count) for t in part.column(1).to_pylist()]
                rows = [(i, k, len(c), n, text) for i, c in enumerate(own) for k, (text, n) in enumerate(c)]
                if rows:
                    at_row, k, n_chunks, n, text = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at_row)), *(pa.array(x, pa.int32()) for x in (k, n_chunks, n)), pa.array(text, pa.string())], names=["of", "chunk_id", "n_chunks", "n_tokens", "text"])

    return kept.mapInArrow(over, f"of {kind}, chunk_id int, n_chunks int, n_tokens int, text string").select("of.*", "chunk_id", "n_chunks", "n_tokens", "text")
