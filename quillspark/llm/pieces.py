"""SentencePiece encoding and decoding as shortest paths of a weighted transducer.

The transducer is compiled from the model. The normaliser (the mark put before a text, the
mark that stands for a space) is composed with the pieces at once: an arc of a piece reads what
the normaliser would make the piece of, a space where the piece has a mark. A character without
a piece has the arcs of its bytes. One automaton over all arcs is walked along an input, and
gives the arcs that end at each character position, the longest first.

In a unigram model an arc weighs minus its piece's score. In a byte-pair model the merges
decide: a path is a merge result exactly if each two neighbouring pieces are what merging their
joined text gives, so an arc after a piece that it doesn't follow has infinite weight. Merging
gives every beginning of a text one result, so of the arcs to a position one at most is finite, and
the first found is the minimum.

Inputs are cut where no arc can reach across: before spaces, and between characters that no
piece has side by side. Each distinct part of a slice is composed once, and remembered by the worker.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .quality import ragged
from .words import per_slice, text_column

SPACE = "▁"
#: Characters of the parts that a worker remembers before it lets go of those it hasn't met since half of that.
REMEMBERED = 3_000_000
#: Pairs of pieces of which a worker knows whether one may follow the other; about 100 bytes each.
PAIRS = 2_000_000


class Transducer:
    """The compiled model. ``encode`` and ``decode`` work on whole texts."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        rules, spec = model.normalizer_spec, model.trainer_spec
        kinds = proto.ModelProto.SentencePiece
        self.merges = spec.model_type == proto.TrainerSpec.BPE
        self.prefix, self.trim, self.escape = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        self.charsmap = SentencePieceProcessor(model_file=model_file).normalize if rules.precompiled_charsmap else None
        self.number = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.score = {i: p.score for i, p in enumerate(model.pieces)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN), 0)
        self.text = [b"" if p.type == kinds.CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.longest = max(map(len, self.number))
        self.alone = {p for p in self.number if len(p) == 1} | {" "} if SPACE in self.number else {p for p in self.number if len(p) == 1}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.number)
        #: Whether every part starts with a space, and none has one behind its first other character.
        self.plain = self.prefix and self.escape and not inner and not self.charsmap and not self.trim
        self.runs = re.compile(r".+" if inner or not self.escape else " *[^ ]+| +", re.DOTALL)
        self.known_chars = regex.compile(f"(?:[{regex.escape(''.join(sorted(self.alone)), special_only=False)}])+|." if self.alone else ".", regex.DOTALL)
        self.follows: dict[int, bool] = {}
        self.piece_of = {i: p for p, i in self.number.items()}
        #: Parts met lately and before, with their ids.
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.held = 0
        self.compile()

    def compile(self) -> None:
        """The automaton of all arcs, by what they read."""
        self.size = {i: len(p) for p, i in self.number.items()}
        #: Neighbouring characters of arcs.
        self.joins = {x[k : k + 2] for p in self.number for x in (p.replace(SPACE, " ") if self.escape else p,) for k in range(len(x) - 1)}
        self.arcs = ahocorasick.Automaton()
        for p, i in self.number.items():
            self.arcs.add_word(p.replace(SPACE, " ") if self.escape else p, i)
        self.arcs.make_automaton()

    def normalised(self, text: str) -> str:
        """What the automaton reads: spaces where the normaliser puts marks."""
        if self.charsmap:
            text = self.charsmap(text)
            return text.replace(SPACE, " ") if self.escape else text
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if self.escape:
            text = text.replace(SPACE, " ")
        return " " + text if self.prefix and text else text

    def merged(self, text: str) -> list[str]:
        """What merging gives: always the pair whose union scores best, the leftmost of equals."""
        own = list(text)
        while len(own) > 1:
            best = None
            for i in range(len(own) - 1):
                n = self.number.get(own[i] + own[i + 1])
                if n is not None and (best is None or self.score[n] > best[0]):
                    best = (self.score[n], i)
            if best is None:
                break
            i = best[1]
            own[i : i + 2] = [own[i] + own[i + 1]]
        return own

    def may_follow(self, a: int, b: int) -> bool:
        x, y = self.piece_of[a], self.piece_of[b]
        if len(self.follows) >= PAIRS:
            self.follows.clear()
        found = self.follows[a << 32 | b] = self.merged(x + y) == [x, y]
        return found

    def shortest(self, text: str) -> tuple[int, ...]:
        """The best path of a part whose characters all have pieces."""
        size, path, at = self.size, [], len(text)
        last: list[int | None] = [None] * (at + 1)
        if self.merges:
            follows = self.follows
            for end, n in self.arcs.iter(text):
                end += 1
                if last[end] is None:
                    before = end - size[n]
                    if before:
                        a = last[before]
                        if a is None:
                            continue
                        finite = follows.get(a << 32 | n)
                        if finite is None:
                            finite = self.may_follow(a, n)
                        if not finite:
                            continue
                    last[end] = n
        else:
            weight = [0.0] + [float("inf")] * at
            for end, n in self.arcs.iter(text):
                own = weight[end + 1 - size[n]] - self.score[n]
                if own < weight[end + 1]:
                    weight[end + 1], last[end + 1] = own, n
        while at:
            n = last[at]
            path.append(n)
            at -= size[n]
        return tuple(path[::-1])

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in char.encode()) if self.bytes else (self.unknown,)

    def path(self, part: str) -> tuple[int, ...]:
        """The ids of a part, cut where no arc goes from one character to the next."""
        joins, a, out = self.joins, 0, ()
        for i in range(1, len(part)):
            if part[i - 1 : i + 1] not in joins:
                out += self.remembered(part[a:i], self.whole)
                a = i
        return out + self.remembered(part[a:], self.whole) if a else self.whole(part)

    def whole(self, part: str) -> tuple[int, ...]:
        if self.alone.issuperset(part):
            return self.shortest(part)
        return tuple(i for x in self.known_chars.findall(part) for i in (self.shortest(x) if x[0] in self.alone else self.fallback(x)))

    def remembered(self, part: str, find) -> tuple[int, ...]:
        ids = self.known.get(part)
        if ids is None:
            ids = self.older.get(part)
            if ids is None:
                ids = find(part)
            self.known[part] = ids
            self.held += len(part)
            if self.held > REMEMBERED:
                self.known, self.older, self.held = {}, self.known, 0
        return ids

    def paths(self, parts: list[str]) -> list[tuple[int, ...]]:
        """The ids of each part."""
        return [self.remembered(p, self.path) for p in parts]

    def cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct parts, the parts of all texts as indexes, how many each text has)."""
        if self.plain:
            words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), SPACE, " "), " ")
            counts, flat = pc.list_value_length(words).to_numpy().astype(np.int64), words.flatten()
            bounds = np.r_[0, np.cumsum(counts)]
            # Only single spaces: each word with the space before it. Other texts are cut below.
            odd = np.add.reduceat(pc.equal(flat, "").to_numpy(zero_copy_only=False).astype(np.int64), bounds[:-1]) > 0 if len(flat) else np.zeros(0, bool)
            stays = np.repeat(~odd, counts)
            coded = flat.filter(pa.array(stays)).dictionary_encode()
            parts, codes = [" " + w for w in coded.dictionary.to_pylist()], np.zeros(len(flat), np.int64)
            codes[stays] = coded.indices.to_numpy()
            if not odd.any():
                return parts, codes, counts
        else:
            odd, bounds, codes, counts, parts = np.ones(len(texts), bool), np.arange(len(texts) + 1), np.zeros(len(texts), np.int64), np.ones(len(texts), np.int64), []
        number = {p: i for i, p in enumerate(parts)}
        own = [codes[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i in np.flatnonzero(odd):
            text = texts[i].as_py()
            own[i] = np.array([number.setdefault(p, len(number)) for p in self.runs.findall(self.normalised(text))] if text else [], np.int64)
        return list(number), np.concatenate([*own, np.zeros(0, np.int64)]), np.array([len(x) for x in own], np.int64)

    def encode(self, text: str) -> list[int]:
        parts, codes, _ = self.cut(pa.array([text], pa.string()))
        paths = self.paths(parts)
        return [i for c in codes for i in paths[c]]

    def spelt(self, ids) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become the replacement character."""
        raw = b"".join(map(self.text.__getitem__, ids))
        return raw[1 if self.prefix and raw[:1] == b" " else 0 :].decode("utf-8", "replace")


@cache
def transducer(model_file: str) -> Transducer:
    return Transducer(model_file)


def sentencepiece_encode(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per input row: n_tokens, n_bytes (tokens that are bytes), ids_crc32 (little-endian 32-bit ids), round_trip, and ids.

    ``round_trip`` says that decoding the ids gives the normalised text back. Null and
    empty texts have no ids. Repeated rows are encoded each on their own, rows without an id too.
    A text of any length is read whole. Of equally good paths (unigram models) the one whose last piece
    is longer is taken. Other columns, whatever their names, are not read. An empty table
    gives an empty result. ``keep_ids=False`` leaves the ids null.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        t = transducer(model_file)
        parts, codes, counts = t.cut(part.column(1))
        paths = t.paths(parts)
        # Parts end with whole characters, so a text comes back exactly if all its parts do.
        lost = np.fromiter((t.spelt(ids) != p for p, ids in zip(parts, paths, strict=True)), bool, len(parts))
        sizes = np.fromiter(map(len, paths), np.int64, len(paths))
        flat = np.fromiter((i for x in paths for i in x), np.uint32, sizes.sum())
        starts, per_part = np.cumsum(sizes) - sizes, sizes[codes]
        ids = flat[ragged(starts[codes], per_part)].astype("<u4")
        ends = np.cumsum(counts)
        bounds, losses = np.r_[0, np.cumsum(per_part)][np.r_[0, ends]], np.r_[0, np.cumsum(lost[codes])][np.r_[0, ends]]
        is_byte = np.zeros(len(t.text), bool)
        is_byte[list(t.bytes.values())] = True
        n_bytes = np.diff(np.r_[0, np.cumsum(is_byte[ids])][bounds])
        lengths = np.diff(bounds)
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        kept = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))) if keep_ids else pa.nulls(part.num_rows, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.diff(losses) == 0), kept], names=["doc_id", "n_tokens", "n_bytes", "ids_crc32", "round_trip", "ids"])

    return text_column(docs, id_col, text_col).mapInArrow(per_slice(run), "doc_id long, n_tokens long, n_bytes long, ids_crc32 long, round_trip boolean, ids array<int>")


def sentencepiece_decode(encoded: DataFrame, model_file: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text. Null ids give a null text, no ids an empty one.

    Lists of any length are decoded whole. The unknown piece gives its name. Rows that repeat a document id, or have none, are decoded each on their own. Other columns,
    whatever their names, are not read; an empty table gives an empty result.
    """

    def over(batches):
        t = transducer(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if ids is None else t.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    read = encoded.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids")
    return read.mapInArrow(over, "doc_id long, text string")
