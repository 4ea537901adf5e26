"""Quality rules with tokeniser fertility.

Each text is measured by public vocabularies, word by word. One of pieces with byte fallback
gives characters per token, the share of tokens that are bytes (the vocabulary has no piece
for a character) and the entropy of its tokens in bits; a byte-level one for many languages
gives characters per token once more; and there are symbols a word. Texts outside the rejection band
of their language, or of their script where the language is unknown, are rejected. The
script is that of most letters of the whole text.

One pass over the texts and no shuffle; a task holds one slice of a few MB.
"""

from __future__ import annotations

import base64
import unicodedata
from collections import Counter
from dataclasses import asdict, dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, per_slice, text_column, windows_inside
from .worker import hold

SYMBOLS = "#*$%&|<>"
#: Text in a slice: a slice holds the ids of its distinct words by two vocabularies.
SLICE_BYTES = 2 << 20


@dataclass(frozen=True)
class Band:
    """What a text may measure. Entropy (bits) is judged from ``entropy_from`` tokens on; below that it says little."""

    chars_low: float
    chars_high: float
    bytes_high: float = 0.10
    entropy_low: float = 4.0
    entropy_from: int = 128
    symbols_high: float = 0.25
    #: Characters per token of the byte-level vocabulary.
    multi_low: float = 0.25


#: The lower bounds of languages and LATIN lie below all rows labelled good at sf0.1 (``multi_low`` 3 % below). Those of other scripts are half
#: and three times what one plain sentence of the script measured, with more bytes than it; "other" is any script not named.
BANDS = {
    "en": Band(1.7, 8.0, multi_low=1.92),
    "fr": Band(1.5, 8.0, multi_low=1.75),
    "de": Band(1.85, 8.0, multi_low=2.09),
    "es": Band(1.6, 8.0, multi_low=1.86),
    "LATIN": Band(1.5, 8.0, multi_low=1.75),
    "CYRILLIC": Band(1.02, 6.15, bytes_high=0.15, multi_low=1.2),
    "GREEK": Band(0.41, 2.46, bytes_high=0.15, multi_low=0.85),
    "ARABIC": Band(0.47, 2.85, bytes_high=0.15, multi_low=0.81),
    "HEBREW": Band(0.41, 2.49, bytes_high=0.15, multi_low=0.71),
    "DEVANAGARI": Band(0.38, 2.25, bytes_high=0.25, multi_low=0.39),
    "CJK": Band(0.39, 2.34, bytes_high=0.60, multi_low=0.38),
    "HANGUL": Band(0.34, 2.01, bytes_high=0.40, multi_low=0.61),
    "THAI": Band(0.49, 2.97, bytes_high=0.15, multi_low=0.59),
    "other": Band(0.25, 8.0, bytes_high=0.95),
}
#: Scripts by the first word of a letter's name, where that isn't the script's own.
ALIASES = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "HALFWIDTH": "CJK", "FULLWIDTH": "LATIN"}

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double, chars_per_token_multi double, band string, kept boolean"
)


@cache
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


@cache
def _byte_level(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def clear() -> None:
    _model.cache_clear()
    _byte_level.cache_clear()


@cache
def _script(char: str) -> str | None:
    """The script of a letter; None for other characters."""
    if not char.isalpha():
        return None
    name = (unicodedata.name(char, "") or "other").split(" ")[0]
    return ALIASES.get(name, name)


def scripts_of(words: Words, unique: list[str], rows: np.ndarray) -> list[str | None]:
    """Of each of ``rows`` (indexes of texts), the script of most of its letters; None without letters."""
    counted: dict[int, Counter] = {}
    out = []
    for i in rows:
        codes, times = np.unique(words.codes[words.bounds[i] : words.bounds[i + 1]], return_counts=True)
        seen: Counter = Counter()
        for c, n in zip(codes.tolist(), times.tolist(), strict=True):
            if c not in counted:
                counted[c] = Counter(filter(None, map(_script, unique[c])))
            for script, k in counted[c].items():
                seen[script] += n * k
        out.append(min(seen, key=lambda x: (-seen[x], x)) if seen else None)
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+length."""
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - before, lengths)


def repeated_words(words: Words, width: int = 3) -> np.ndarray:
    """Per text, the words inside windows of ``width`` words that the text holds twice or more."""
    counts = words.counts()
    at = windows_inside(counts, width)
    key = words.codes[at].astype(np.int64)
    size = len(words.unique)
    for k in range(1, width):
        if size > (1 << 62) // max(1, len(words.unique)):
            key, distinct = pd.factorize(key)
            size = len(distinct)
        key = key * len(words.unique) + words.codes[at + k]
        size *= len(words.unique)
    key, distinct = pd.factorize(key)
    twice = np.bincount(key, minlength=len(distinct))[key] > 1
    at, key, owner = at[twice], key[twice], words.owner()
    key, distinct = pd.factorize(owner[at] * np.int64(len(distinct) + 1) + key)
    at = at[np.bincount(key, minlength=len(distinct))[key] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.bincount(owner[np.cumsum(edge)[:-1] > 0], minlength=len(counts))


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _measured(path: str, multi: tuple[str, str] | None, bands: dict[str, dict]):
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        hold("quality rules", clear)
        model, is_byte = _model(path)
        texts, langs = part.column(1), part.column(2).to_pylist()
        words = Words(texts)
        n_words, n = words.counts(), len(texts)
        unique = [w.decode("utf-8", "replace") for w in words.unique.to_pylist()]

        def total(per_word: np.ndarray) -> np.ndarray:
            sums = np.r_[0, np.cumsum(per_word[words.codes])]
            return sums[words.bounds[1:]] - sums[words.bounds[:-1]]

        ids = model.encode(unique, num_threads=1) if unique else []
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, sizes.sum())
        starts = np.cumsum(sizes) - sizes
        byte_counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[is_byte[flat]], minlength=len(sizes))
        n_tokens, n_bytes = total(sizes), total(byte_counts)
        chars = total(np.fromiter(map(len, unique), np.int64, len(unique)))
        symbols = total(np.asarray(pc.count_substring_regex(pa.array(unique, pa.string()), f"[{SYMBOLS}]"), np.int64))
        entropy = np.zeros(n)
        for i in np.flatnonzero(n_tokens):
            own = words.codes[words.bounds[i] : words.bounds[i + 1]]
            seen = flat[ragged(starts[own], sizes[own])]
            share = (np.bincount(seen) if len(seen) > 8000 else np.unique(seen, return_counts=True)[1]) / len(seen)
            share = share[share > 0]
            entropy[i] = -(share * np.log2(share)).sum()
        repeats = repeated_words(words)
        base_failed = (n_words < 50) | (100 * repeats > 50 * n_words)
        per_token = np.where(n_tokens > 0, chars / np.maximum(n_tokens, 1), 0.0)
        byte_share = n_bytes / np.maximum(n_tokens, 1)
        per_multi = np.full(n, np.nan)
        if multi:
            encode = _byte_level(*multi).encode_ordinary
            again = total(np.fromiter((len(encode(" " + w)) for w in unique), np.int64, len(unique)))
            per_multi = np.where(again > 0, chars / np.maximum(again, 1), 0.0)
        named = [x if x in bands else "other" for x in langs]
        unknown = np.flatnonzero([x not in bands for x in langs])
        for i, script in zip(unknown, scripts_of(words, unique, unknown), strict=True):
            named[i] = script if script in bands else "other"
        band = {k: np.array([bands[x][k] for x in named], float) for k in ("chars_low", "chars_high", "bytes_high", "entropy_low", "entropy_from", "symbols_high", "multi_low")}
        enough = n_tokens >= band["entropy_from"]
        kept = ~base_failed & (per_token >= band["chars_low"]) & (per_token <= band["chars_high"]) & (byte_share <= band["bytes_high"])
        kept &= symbols <= band["symbols_high"] * n_words
        kept &= np.isnan(per_multi) | (per_multi >= band["multi_low"])
        kept &= ~enough | (entropy >= band["entropy_low"])
        dup = [duplicate_lines(t) for t in texts.to_pylist()]
        return pa.RecordBatch.from_arrays(
            [part.column(0), *(pa.array(x, pa.int64()) for x in (n_words, chars, symbols, dup, repeats)), pa.array(base_failed), pa.array(n_tokens, pa.int64()), pa.array(per_token), pa.array(byte_share), pa.array(entropy), pa.array(per_multi, from_pandas=True), pa.array(named), pa.array(kept)],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )

    return run


def quality_rules(docs: DataFrame, vocabulary: str, bands: dict[str, Band] | None = None, *, multi: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per input row: the counts, the fertility measures and the verdict.

    ``vocabulary`` is the path of a SentencePiece model that every executor can open, ``multi`` the path of
    a byte-level vocabulary (tokens in base 64, and ranks) and its pattern; without it chars_per_token_multi is null.
    Null and empty texts have no words, fail the base rule (under 50 words) and
    measure zero. Repeated rows are judged each on their own. A null or unknown
    language, or ``lang_col=None``, falls back to the band of the script of most letters, or
    to "other" for scripts that ``bands`` doesn't hold and texts without letters; ``bands``
    must hold "other". A measure on a bound stays inside the band. Rows without an id are judged too. Texts of any
    length are measured whole. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    held = {k: asdict(v) for k, v in (bands or BANDS).items()}
    return text_column(docs, id_col, text_col, lang.alias("lang")).mapInArrow(per_slice(_measured(vocabulary, multi, held), limit=SLICE_BYTES), SCHEMA)
