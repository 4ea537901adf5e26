"""Cross-tokenizer alignment, with pairs counted by external spilling.

Two tokenizers cut a text in different places. Where tokens of both end at one byte, the text is cut into groups, and each token of
the one side in a group is linked with each of the other. How many documents hold a pair of ids linked is counted over the whole corpus.

A task codes its documents word by word (both tokenizers always cut before a single space and never look across it), sums the links of each
pair in a document, and spills the pairs of some million records at a time as sorted runs: dealt to radix classes of the first side's
id, ordered by first id, second id and document, differences written in bytes and compressed by zstd. Runs are rows of a table in the shared folder,
so any executor can merge them.

The first merge reads the pairs of a class's runs through a heap, and gives for each pair the number of documents. The second has the
counts of a class in the order of the first side's ids, so that the highest count of an id is known when its pairs have passed, and streams each
document's share back: links times count, and links whose count is the highest. Classes of many records are
merged in several parts, each of whole runs; a document lies in one run, so counts of parts add up.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import ragged
from .shared import written
from .words import sliced, text_column

SPACE = "▁"
#: Classes of first ids, and the records that a run and one part of a merge hold.
CLASSES, RUN_RECORDS, MERGED_RECORDS = 32, 1_000_000, 4_000_000
#: Text in a slice: the more, the fewer words are coded again.
SLICE_BYTES = 4 << 20
#: Words that are coded as one text, and the links of a group beyond which equal tokens of it are counted first.
TOGETHER, LARGE_GROUP = 1000, 4096
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RUNS = f"row long, class int, run long, base long, n long, pairs binary, links binary, {DIGEST}"
CUT = re.compile(r"(?<! )(?= [^\s])")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 ones for themselves, the others, in order, from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Words:
    """Alignments of some words: of each the number of its tokens of either side, groups and links, its groups as told (each with a ``;`` at
    its end), whether both sides give it back, and, of its links, the pairs (first id << 32 | second id) and how many."""

    counts: np.ndarray
    told: list[str]
    exact: np.ndarray
    starts: np.ndarray
    pairs: np.ndarray
    links: np.ndarray

    @staticmethod
    def joined(parts: list[Words]) -> Words:
        if not parts:
            return Words(np.zeros((0, 4), np.int64), [], np.zeros(0, bool), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        sizes = np.concatenate([np.diff(w.starts) for w in parts])
        counts, exact, pairs, links = (np.concatenate([getattr(w, x) for w in parts]) for x in ("counts", "exact", "pairs", "links"))
        return Words(counts, [t for w in parts for t in w.told], exact, np.r_[0, np.cumsum(sizes)], pairs, links)

    def taken(self, order: np.ndarray) -> Words:
        sizes = np.diff(self.starts)[order]
        at = ragged(self.starts[order], sizes)
        return Words(self.counts[order], [self.told[i] for i in order.tolist()], self.exact[order], np.r_[0, np.cumsum(sizes)], self.pairs[at], self.links[at])


class Aligner:
    """Both tokenizers, with what each of their ids is."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_level)
        self.first.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(map(alphabet.__getitem__, t)) for t, i in self.first.get_vocab(with_added_tokens=False).items()}
        self.second = SentencePieceProcessor(model_file=pieces)
        n = self.second.get_piece_size()
        names = [self.second.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        # Words can be coded alone if no piece reaches over a space.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in names)
        sizes = lambda x: np.array([len(x.get(i, b"")) for i in range(max(x) + 1)], np.int64)
        self.a_size, self.b_size = sizes(self.a_bytes), sizes(dict(enumerate(self.b_bytes)))
        self.a_opens = np.array([self.a_bytes.get(i, b"")[:1] == b" " for i in range(len(self.a_size))], bool)
        self.b_opens = np.array([x[:1] == b" " for x in self.b_bytes], bool)
        # An id in decimal with what may follow it: another of its side, the other side, the next group.
        self.a_told, self.b_told = ([np.array([f"{i}{x}" for i in range(len(n))], object) for x in ends] for n, ends in ((self.a_size, ",|"), (self.b_size, ",;")))

    def words(self, text: str) -> list[str]:
        """The parts of a text, which starts with a space: cut before single spaces where a word follows."""
        return [w for w in CUT.split(text) if w] if self.by_word else [text]

    def cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct words, the words of all texts as places in them, how many each text has); a null or empty text has none."""
        texts = pc.fill_null(texts, "")
        blank = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        codes, plain = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        # Other parts than words after single spaces: their texts are cut one by one.
        odd_word = np.array([not w or w[0].isspace() for w in plain], bool)
        bounds = np.r_[0, np.cumsum(counts)]
        odd = np.add.reduceat(odd_word[codes].astype(np.int64), bounds[:-1]) > 0 if len(codes) else np.zeros(0, bool)
        names = {" " + w: i for i, w in enumerate(plain)}
        own = [codes[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i in range(len(texts)) if not self.by_word else np.flatnonzero(odd | blank):
            parts = [] if blank[i] else self.words(" " + texts[i].as_py())
            own[i] = np.array([names.setdefault(w, len(names)) for w in parts], np.int64)
        sizes = np.array([len(x) for x in own], np.int64)
        codes = np.concatenate([*own, np.zeros(0, np.int64)])
        used = np.flatnonzero(np.bincount(codes, minlength=len(names)))
        place = np.zeros(len(names), np.int64)
        place[used] = np.arange(len(used))
        names = list(names)
        return [names[i] for i in used.tolist()], place[codes], sizes

    def aligned(self, text: str) -> Words:
        """The alignment of one text that starts with a space, whatever it is."""
        a_ids, b_ids = self.first.encode(text, add_special_tokens=False).ids, self.second.encode(text[1:])
        a_parts, b_parts = [self.a_bytes[i] for i in a_ids], [self.b_bytes[i] for i in b_ids]
        exact = b"".join(a_parts) == text.encode("utf-8", "replace") == b"".join(b_parts)
        told, pairs, n_groups = [], {}, 0
        a = b = a_end = b_end = i = j = 0
        while exact and i < len(a_ids):
            a_end, b_end, i, j = a_end + len(a_parts[i]), b_end + len(b_parts[j]), i + 1, j + 1
            while a_end != b_end:
                if a_end < b_end:
                    a_end, i = a_end + len(a_parts[i]), i + 1
                else:
                    b_end, j = b_end + len(b_parts[j]), j + 1
            n_groups += 1
            told.append(",".join(map(str, a_ids[a:i])) + "|" + ",".join(map(str, b_ids[b:j])) + ";")
            for u, k in _counted(a_ids[a:i]):
                for v, n in _counted(b_ids[b:j]):
                    pairs[u << 32 | v] = pairs.get(u << 32 | v, 0) + k * n
            a, b = i, j
        counts = np.array([[len(a_ids), len(b_ids), n_groups, sum(pairs.values())]], np.int64)
        return Words(counts, ["".join(told)], np.array([exact]), np.array([0, len(pairs)]), np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))

    def many(self, words: list[str]) -> Words:
        """The alignments of plain words (a space, then none), coded as one text: tokens that start with a space are words' first ones."""
        text = "".join(words)
        a, b = np.array(self.first.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64), np.array(self.second.encode(text[1:]), np.int64)
        raw = text.encode("utf-8", "replace")
        plain = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b.tolist()))
        if not plain or self.a_opens[a].sum() != len(words) or self.b_opens[b].sum() != len(words):
            return Words.joined([self.aligned(w) for w in words])
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        cuts = a_end[np.isin(a_end, b_end, assume_unique=True)]
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        n_a, n_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        if (n_a * n_b).max() > LARGE_GROUP:
            return Words.joined([self.aligned(w) for w in words])
        # Each token of the one side with each of the other in its group.
        a_from, b_from = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        right = ragged(b_from[a_group], n_b[a_group])
        pairs = np.repeat(a, n_b[a_group]) << 32 | b[right]
        # The words of groups; a group lies in one word.
        first = np.flatnonzero(self.a_opens[a])
        of_group = np.searchsorted(first, a_from, side="right") - 1
        n = len(words)
        of_word = lambda x: np.bincount(of_group, x, minlength=n).astype(np.int64)
        counts = np.stack([of_word(n_a), of_word(n_b), of_word(np.ones(len(cuts))), of_word(n_a * n_b)], 1)
        # Groups as told: the ids in order, each with what follows it.
        a_last, b_last = np.r_[a_group[1:] != a_group[:-1], True], np.r_[b_group[1:] != b_group[:-1], True]
        told = np.empty(len(a) + len(b), object)
        told[np.arange(len(a)) + b_from[a_group]] = np.where(a_last, self.a_told[1][a], self.a_told[0][a])
        told[np.arange(len(b)) + (a_from + n_a)[b_group]] = np.where(b_last, self.b_told[1][b], self.b_told[0][b])
        flat, ends = told.tolist(), np.r_[0, np.cumsum(counts[:, 0] + counts[:, 1])].tolist()
        return Words(counts, ["".join(flat[x:y]) for x, y in zip(ends, ends[1:], strict=False)], np.ones(n, bool), np.r_[0, np.cumsum(counts[:, 3])], pairs, np.ones(len(pairs), np.int64))

    def alignments(self, words: list[str]) -> Words:
        plain = np.array([self.by_word and len(w) > 1 and w[0] == " " and not w[1].isspace() and " " not in w[1:] and SPACE not in w for w in words], bool)
        some, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        parts = [self.many([words[i] for i in some[at : at + TOGETHER].tolist()]) for at in range(0, len(some), TOGETHER)]
        return Words.joined([*parts, *(self.aligned(words[i]) for i in others.tolist())]).taken(np.argsort(np.r_[some, others], kind="stable"))


def _counted(ids: list[int]) -> list[tuple[int, int]]:
    found: dict[int, int] = {}
    for i in ids:
        found[i] = found.get(i, 0) + 1
    return list(found.items())


@cache
def aligner(byte_level: str, pieces: str) -> Aligner:
    return Aligner(byte_level, pieces)


def _packed(*columns: np.ndarray) -> bytes:
    """Integers as bytes, each column's equal places side by side, compressed."""
    return zstandard.compress(b"".join(c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns), 1)


def _unpacked(raw: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    flat, out = np.frombuffer(zstandard.decompress(raw), np.uint8), []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(flat[: n * size].reshape(size, n).T).view(kind).ravel())
        flat = flat[n * size :]
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """Links of a pair within a document: 65,535 stands for more, which the caller tells apart."""
    return np.minimum(x, 65535).astype(np.uint16)


def _spilt(base: int, key: np.ndarray, row: np.ndarray, links: np.ndarray) -> Iterator[dict]:
    """The runs of some documents' records, one for each class that has any."""
    own = class_of(key)
    # The sort is stable: rows of a pair that ascend stay in order.
    order = np.lexsort((key, own)) if (row[1:] >= row[:-1]).all() else np.lexsort((row, key, own))
    own, key, row, links = own[order], key[order], row[order], links[order]
    ends = np.flatnonzero(np.r_[own[1:] != own[:-1], True]) + 1 if len(own) else []
    start = 0
    for end in ends:
        k, r, n = key[start:end], row[start:end], links[start:end]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[first, len(k)]).astype(np.uint32)
        step = np.diff(np.r_[0, k[first]]).astype(np.uint64)
        gaps = np.diff(np.r_[0, r])
        gaps[first] = r[first]
        many = np.flatnonzero(n >= 65535)
        yield {
            "class": int(own[start]), "base": base, "n": len(k),
            "pairs": len(first).to_bytes(8, "little") + _packed(step, sizes),
            "links": len(many).to_bytes(8, "little") + many.astype(np.int64).tobytes() + n[many].astype(np.int64).tobytes() + _packed(gaps.astype(np.uint32), _narrow(n)),
        }
        start = end


def pairs_of_run(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(pairs in order, documents of each)."""
    n = int.from_bytes(raw[:8], "little")
    step, sizes = _unpacked(raw[8:], n, "<u8", "<u4")
    return np.cumsum(step.astype(np.int64)), sizes.astype(np.int64)


def links_of_run(raw: bytes, n: int, base: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, links) of each record, in the order of pairs."""
    m = int.from_bytes(raw[:8], "little")
    many, values = np.frombuffer(raw[8 : 8 + 8 * m], np.int64), np.frombuffer(raw[8 + 8 * m : 8 + 16 * m], np.int64)
    gaps, links = _unpacked(raw[8 + 16 * m :], n, "<u4", "<u2")
    total = np.cumsum(gaps.astype(np.int64))
    first = np.cumsum(sizes) - sizes
    rows = total - np.repeat(total[first] - gaps[first].astype(np.int64), sizes)
    links = links.astype(np.int64)
    links[many] = values
    return rows + base, links


def class_of(key: np.ndarray) -> np.ndarray:
    """The radix class of a pair: bits of its first id, mixed so that neighbours are apart."""
    mixed = (key >> 32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(48)).astype(np.int64) % CLASSES


def _coded(byte_level: str, pieces: str):
    """Rows of two kinds: a document's digest (class -1), and runs."""
    names = [c.split()[0] for c in RUNS.split(", ")]
    digest = [c.split()[0] for c in DIGEST.split(", ")]

    def batch(n: int, columns: dict) -> pa.RecordBatch:
        kinds = {"class": pa.int32(), "pairs": pa.binary(), "links": pa.binary(), "groups_sha256": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names=names)

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_level, pieces)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        base = 0

        def spill() -> Iterator[pa.RecordBatch]:
            key, row, links = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for run in _spilt(base, key, row - base, links):
                yield batch(1, {"run": [base + run["class"]]} | {k: [v] for k, v in run.items()})

        for part in sliced(batches, limit=SLICE_BYTES):
            ids, rows = part.column(0).to_pylist(), part.column(2).to_numpy()
            words, codes, sizes = both.cut(part.column(1))
            found = both.alignments(words)
            bounds = np.r_[0, np.cumsum(sizes)]
            doc = np.repeat(np.arange(part.num_rows), sizes)
            lacking = np.bincount(doc, ~found.exact[codes], minlength=part.num_rows) > 0
            sums = np.stack([np.bincount(doc, found.counts[codes, k], minlength=part.num_rows) for k in range(4)], 1).astype(np.int64)
            told, listed, hashes = found.told, codes.tolist(), []
            for i, (x, y) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                groups = "".join(map(told.__getitem__, listed[x:y]))
                if lacking[i]:
                    # Bytes that a word lacks may be made up for by another one: the whole text decides.
                    whole = both.aligned(" " + part.column(1)[i].as_py())
                    groups, sums[i] = (whole.told[0], whole.counts[0]) if whole.exact[0] else ("", 0)
                    order = np.argsort(whole.pairs)
                    held.append((whole.pairs[order], np.full(len(order), rows[i]), whole.links[order]))
                hashes.append(hashlib.sha256(groups[:-1].encode()).hexdigest() if groups else "")
            yield batch(part.num_rows, {"row": rows, "class": np.full(part.num_rows, -1)} | dict(zip(digest, [ids, *sums.T, hashes], strict=True)))
            # The words of each document with their times, then their pairs.
            used, times = np.unique((doc * len(words) + codes)[~lacking[doc]], return_counts=True)
            doc, codes = used // max(1, len(words)), used % max(1, len(words))
            lengths = np.diff(found.starts)[codes]
            at = ragged(found.starts[codes], lengths)
            doc, key, n = np.repeat(doc, lengths), found.pairs[at], np.repeat(times, lengths) * found.links[at]
            order = np.lexsort((key, doc))
            doc, key, n = doc[order], key[order], n[order]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][: len(key)])
            if len(first):
                held.append((key[first], rows[doc[first]], np.add.reduceat(n, first)))
            held[:] = [x for x in held if len(x[0])]
            if held:
                base = min(int(x[1].min()) for x in held)
                if sum(len(x[0]) for x in held) >= RUN_RECORDS:
                    yield from spill()
        if held:
            yield from spill()

    return over


def merged(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs in order, documents of each) of sorted runs, through a heap of their heads."""
    read = [pairs_of_run(r) for r in runs]
    if len(read) == 1:
        return read[0]
    heads = heapq.merge(*(zip(k.tolist(), n.tolist(), strict=True) for k, n in read))
    keys, counts, last = [], [], None
    for key, n in heads:
        if key == last:
            counts[-1] += n
        else:
            keys.append(key)
            counts.append(n)
            last = key
    return np.array(keys, np.int64), np.array(counts, np.int64)


def _pair_counts(key: tuple, runs: pa.Table) -> pa.Table:
    found, n = merged(runs.column("pairs").to_pylist())
    return pa.table([pa.array(np.full(len(found), key[0].as_py(), np.int32)), pa.array(found), pa.array(n)], names=["class", "pair", "n_docs"])


def _contributions(key: tuple, runs: pa.Table, counts: pa.Table) -> pa.Table:
    """(row, n_best, count_sum) of the documents of a part's runs, of the pairs of one class."""
    pair, n = counts.column("pair").to_numpy(), counts.column("n_docs").to_numpy()
    order = np.argsort(pair, kind="stable")
    pair, n = pair[order], n[order]
    side = pair >> 32
    starts = np.flatnonzero(np.r_[True, side[1:] != side[:-1]]) if len(side) else np.zeros(0, np.int64)
    best = n == np.repeat(np.maximum.reduceat(n, starts), np.diff(np.r_[starts, len(side)])) if len(side) else np.zeros(0, bool)
    out = [(np.zeros(0, np.int64),) * 3]
    for r in runs.select(["base", "n", "pairs", "links"]).to_batches(max_chunksize=1):
        base, size, head, tail = (r.column(i)[0].as_py() for i in range(4))
        own, sizes = pairs_of_run(head)
        rows, links = links_of_run(tail, size, base, sizes)
        at = np.repeat(np.searchsorted(pair, own), sizes)
        order = np.argsort(rows, kind="stable")
        rows, links, at = rows[order], links[order], at[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out.append((rows[first], np.add.reduceat(links * best[at], first), np.add.reduceat(links * n[at], first)))
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["row", "n_best", "count_sum"])


@dataclass(frozen=True)
class Alignment:
    """``documents``: a row for each document. ``pairs``: (a_id, b_id, n_docs, is_best), a row for each pair of ids that any document holds linked."""

    documents: DataFrame
    pairs: DataFrame


def cross_tokenizer_alignment(docs: DataFrame, byte_level: str, pieces: str, *, id_col: str = "doc_id", text_col: str = "text") -> Alignment:
    """Align a byte-level vocabulary (A, a tokenizers file) with a sentencepiece model (B) over whole texts.

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. A reads a space and the text, B puts its space itself; special
    tokens' strings are plain text. Null and empty texts, and those that the bytes of A's or B's tokens don't give back, have zeros and an empty
    hash. Each row is a document, those that repeat an id or have none too, and counts as one in the number of documents of a pair. Of pairs that
    share the highest count of their A id all are best. A text of any length is read whole; a text whose words can't be told apart is coded
    as one. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    read = text_column(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    coded = written(read.mapInArrow(_coded(byte_level, pieces), RUNS), "runs")
    digests, runs = coded.where("class = -1"), coded.where("class >= 0")
    # CLASSES rows: into how many parts of whole runs a class is dealt.
    parts = runs.groupBy("class").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / MERGED_RECORDS)).cast("int").alias("parts"))
    dealt = runs.select("class", "run", "base", "n", "pairs", "links").join(F.broadcast(parts), "class").withColumn("part", F.pmod(F.xxhash64("run"), "parts").cast("int"))
    partial = dealt.select("class", "part", "pairs").groupBy("class", "part").applyInArrow(_pair_counts, "class int, pair long, n_docs long")
    counts = written(partial.groupBy("class", "pair").agg(F.sum("n_docs").alias("n_docs")), "pairs")
    sent = counts.join(F.broadcast(parts), "class").select("class", "pair", "n_docs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).toDF("c", "pair", "n_docs", "p")
    shares = dealt.drop("run", "parts").groupBy("class", "part").cogroup(sent.groupBy("c", "p")).applyInArrow(_contributions, "row long, n_best long, count_sum long")
    shares = shares.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = digests.select("row", *(c.split()[0] for c in DIGEST.split(", "))).join(shares, "row", "left")
    documents = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    ids = counts.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), "n_docs")
    top = ids.groupBy("a_id").agg(F.max("n_docs").alias("top"))
    return Alignment(documents, ids.join(top, "a_id").select("a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("top")).alias("is_best")))
