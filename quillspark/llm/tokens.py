"""Token ids of whole texts by a public tokenizers file, coded word by word.

The vocabulary's splitting never joins characters across ASCII white space, so a
text's ids are its words' ids in order. Distinct words are encoded once per slice
and kept in a bounded cache of the worker.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa

from .quality import ragged
from .words import Words
from .worker import hold

#: Bytes of the words that a worker remembers, the first that it meets, with their ids and what Python keeps for each.
CACHED_BYTES, BYTES_EACH = 64 << 20, 150


@cache
def tokenizer(path: str):
    """(the tokenizer, a string that it always makes one id, that id)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    number, mark = min((i, t.content) for i, t in found.get_added_tokens_decoder().items() if t.special)
    return found, mark, number


_known: dict[str, dict[bytes, bytes]] = {}
_held: dict[str, int] = {}


def clear() -> None:
    _known.clear()
    _held.clear()
    tokenizer.cache_clear()
    _bytes_of.cache_clear()


@cache
def _bytes_of(path: str) -> np.ndarray:
    """How many bytes each id stands for in a byte-level vocabulary, in which a character of a token is a byte, the mark of a word's end aside."""
    found = tokenizer(path)[0]
    end = getattr(found.model, "end_of_word_suffix", None) or ""
    out = np.zeros(max(found.get_vocab().values()) + 1, np.int64)
    for token, i in found.get_vocab().items():
        out[i] = len(token.removesuffix(end)) if end else len(token)
    return out


def _lengths(path: str, words: list[str]) -> np.ndarray | None:
    """The bytes of each word as the vocabulary's normaliser makes it; None if it makes more or fewer words of them."""
    out = np.fromiter(map(len, words), np.int64, len(words))
    other = [i for i, w in enumerate(words) if not w.isascii()]
    normaliser = tokenizer(path)[0].normalizer
    if other:
        text = " ".join(words[i] for i in other)
        own = (normaliser.normalize_str(text) if normaliser else text).split(" ")
        if len(own) != len(other):
            return None
        out[other] = [len(w.encode()) for w in own]
    return out


def _joined(path: str, words: list[str]) -> list[bytes] | None:
    """Each word's ids, from texts of words with a space between. A word ends where the bytes of the ids so far are those of the words so far; None if one doesn't."""
    sizes = _lengths(path, words)
    if sizes is None:
        return None
    batch = tokenizer(path)[0].encode_batch_fast([" ".join(words[k : k + 100]) for k in range(0, len(words), 100)], add_special_tokens=False)
    ids = np.concatenate([np.array(e.ids, "<u4") for e in batch] or [np.zeros(0, "<u4")])
    ends, wanted = np.cumsum(_bytes_of(path)[ids]), np.cumsum(sizes)
    at = np.searchsorted(ends, wanted)
    if not len(ends) or ends[-1] != wanted[-1] or (ends[at] != wanted).any():
        return None
    cuts, raw = [0, *(4 * (at + 1)).tolist()], ids.tobytes()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _marked(path: str, words: list[str]) -> list[bytes]:
    """Each word's ids, from texts of words that a special token follows each."""
    found, mark, number = tokenizer(path)
    plain = [w if mark not in w else "" for w in words]
    texts = ["".join(f"{w} {mark} " for w in plain[k : k + 100]) for k in range(0, len(plain), 100)]
    ids = np.concatenate([np.array(e.ids, "<u4") for e in found.encode_batch_fast(texts, add_special_tokens=False)])
    cuts = np.r_[-1, np.flatnonzero(ids == number)]
    raw = ids.tobytes()
    own = [raw[4 * (a + 1) : 4 * b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
    for i, w in enumerate(words):
        if mark in w:
            own[i] = np.array(found.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
    return own


def encoded(path: str, words: list[bytes]) -> list[bytes]:
    """Each word's ids as little-endian 32-bit integers. Words go to the tokenizer as few long texts; where the ids of words can't be told apart by
    their bytes (white space of other kinds or special tokens in a word, vocabularies of another kind), a special token follows each."""
    mark = tokenizer(path)[1]
    out: list[bytes] = []
    for at in range(0, len(words), 2000):
        some = [w.decode("utf-8", "replace") for w in words[at : at + 2000]]
        odd = [i for i, w in enumerate(some) if mark in w or not w.isprintable()]
        apart = set(odd)
        rest = [i for i in range(len(some)) if i not in apart] if odd else range(len(some))
        own: list[bytes] = [b""] * len(some)
        for which, how in ((rest, lambda x: _joined(path, x) or _marked(path, x)), (odd, lambda x: _marked(path, x))):
            if len(which):
                for i, ids in zip(which, how([some[i] for i in which]), strict=True):
                    own[i] = ids
        out += own
    return out


def word_ids(path: str, words: list[bytes]) -> list[bytes]:
    known = _known.setdefault(path, {})
    out = [known.get(w) for w in words]
    missing = [i for i, x in enumerate(out) if x is None]
    held = _held.get(path, 0)
    for i, ids in zip(missing, encoded(path, [words[i] for i in missing]), strict=True):
        out[i] = ids
        size = len(words[i]) + len(ids) + BYTES_EACH
        if held + size <= CACHED_BYTES:
            known[words[i]] = ids
            held += size
    _held[path] = held
    return out


def text_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, bounds): text i has ids[bounds[i]:bounds[i + 1]]."""
    hold("token ids", clear)
    words = Words(texts)
    ids = word_ids(path, words.unique.to_pylist())
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<u4")
    starts = np.cumsum(sizes) - sizes
    per_word = sizes[words.codes]
    bounds = np.r_[0, np.cumsum(per_word)][words.bounds]
    return flat[ragged(starts[words.codes], per_word)], bounds
