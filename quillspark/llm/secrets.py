"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams is derived that every
text it matches must satisfy. Each slice of the table is an index segment: postings of
the trigrams that some query names, over ASCII-lower-cased text. The postings are
intersected and united as the query says, and only the rows left are read by the
expression itself. A rule without mandatory trigrams reads every row.

One pass and no shuffle: segments are independent, as in any segmented text index.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import product
from re import _constants as kinds
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _offsets, per_slice, text_column


@dataclass(frozen=True)
class Rule:
    """``least`` is the number of characters that ``group`` of a match must have to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + f"|{either_case('api')}_?{either_case('key')}"
BASE_RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Public formats of credentials, found besides.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"://[^\s:@/]{1,64}:[^\s:@/]{1,64}@"),
)

#: A query is True (no demand), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple[str, tuple]
_STRINGS = 64


def _both(op: str, parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if op == "or" and True in parts:
        return True
    parts = [p for p in parts if p is not True]
    if op == "or" and all(isinstance(p, str) or p[0] == "and" and all(isinstance(x, str) for x in p[1]) for p in parts):
        # An alternative that demands all that another does, and more, adds nothing.
        sets = [frozenset([p]) if isinstance(p, str) else frozenset(p[1]) for p in parts]
        parts = [p for p, own in zip(parts, sets, strict=True) if not any(other < own for other in sets)]
    return True if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _needs(strings: frozenset[str]) -> Query:
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) if len(s) > 2 else True for s in sorted(strings)])


def _item(op, value) -> tuple[frozenset[str] | None, Query]:
    """(all strings the item matches, or None if they are too many; what any match needs)."""
    if op is kinds.LITERAL:
        return frozenset({chr(value).lower()}), True
    if op is kinds.IN:
        chars: set[str] = set()
        for k, v in value:
            if k is kinds.LITERAL:
                chars.add(chr(v).lower())
            elif k is kinds.RANGE and v[1] - v[0] < 8:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, True
        return (frozenset(chars), True) if len(chars) <= 8 else (None, True)
    if op is kinds.SUBPATTERN:
        return _sequence(value[-1])
    if op is kinds.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(p[0] is not None for p in parts) and sum(len(p[0]) for p in parts) <= _STRINGS:
            return frozenset().union(*(p[0] for p in parts)), True
        return None, _both("or", [q if s is None else _both("and", [_needs(s), q]) for s, q in parts])
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if strings is not None and high == 1:
            return strings | ({""} if low == 0 else frozenset()), True
        if low == 0:
            return None, True
        return None, query if strings is None else _both("and", [_needs(strings), query])
    return None, True


def _sequence(items) -> tuple[frozenset[str] | None, Query]:
    strings, exact, needs = frozenset({""}), True, []
    for op, value in items:
        some, query = _item(op, value)
        needs.append(query)
        if some is not None and len(some) * len(strings) <= _STRINGS:
            strings = frozenset(a + b for a, b in product(strings, some))
            continue
        needs.append(_needs(strings))
        exact = exact and some is not None
        strings = some if some is not None else frozenset({""})
        exact = False
    if exact:
        return strings, _both("and", needs)
    return None, _both("and", [*needs, _needs(strings)])


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that any text matching ``pattern`` must hold."""
    strings, query = _sequence(parser.parse(pattern))
    return query if strings is None else _both("and", [_needs(strings), query])


def trigrams(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set() if query is True else set().union(*map(trigrams, query[1]))


class Segment:
    """Postings of the named trigrams over the rows of one slice."""

    def __init__(self, texts: pa.Array, named: tuple[str, ...]):
        self.rows = len(texts)
        self.number = {t: i for i, t in enumerate(named)}
        offsets = _offsets(texts)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint32)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
        hits = _lookup(named)[codes]
        at = np.flatnonzero(hits)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        both = np.unique((hits[at[inside]].astype(np.int64) - 1) * self.rows + row[inside])
        cuts = np.searchsorted(both, np.arange(len(named) + 1) * self.rows)
        self.postings = [both[a:b] - k * self.rows for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def rows_for(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, str):
            return self.postings[self.number[query]]
        op, parts = query
        found = sorted(map(self.rows_for, parts), key=len)
        out = found[0]
        for other in found[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if op == "and" else np.union1d(out, other)
        return out


@cache
def _lookup(named: tuple[str, ...]) -> np.ndarray:
    """For each three bytes, 0 or one more than the number of the trigram."""
    table = np.zeros(1 << 24, np.uint8 if len(named) < 255 else np.uint16)
    for i, t in enumerate(named):
        a, b, c = t.encode()
        table[a << 16 | b << 8 | c] = i + 1
    return table


@cache
def _compiled(rules: tuple[Rule, ...]):
    queries = []
    for r in rules:
        q = trigram_query(r.pattern)
        queries.append(q if all(t.isascii() for t in trigrams(q)) else True)
    named = tuple(sorted(set().union(*map(trigrams, queries))))
    return [(r, re.compile(r.pattern), q) for r, q in zip(rules, queries, strict=True)], named


def spans(rule: Rule, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap, without those that are too short."""
    for m in pattern.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.span()


def redacted(text: str, found: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for start, end in sorted(found):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _digest(found: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{start}:{end}" for start, k, end in sorted(found))


def secret_scan(docs: DataFrame, more_rules: tuple[Rule, ...] = MORE_RULES, *, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: counts, spans (code points, end exclusive), and the text with its spans replaced by ``mark``.

    Null and empty texts have no spans and keep their null or empty text. Spans are
    ordered by start, then kind as listed; base spans stay whatever else is found.
    Spans that tie in start and kind are the same span. Texts of any length are scanned whole. Repeated rows are scanned each on
    their own, rows without an id too. An empty table gives an empty result. ``carry`` names columns to return besides; one that has the name of
    a column of the result comes back as ``carried_`` and its name. Other columns, whatever their names, are not read.
    """
    rules = BASE_RULES + tuple(more_rules)
    n_base = len(BASE_RULES)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        compiled, named = _compiled(rules)
        column = part.column(1).fill_null("")
        texts, segment = column.to_pylist(), Segment(column, named)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, pattern, query) in enumerate(compiled):
            for i in segment.rows_for(query).tolist():
                found[i] += [(start, k, end) for start, end in spans(rule, pattern, texts[i])]
        counts = [[sum(x[1] == k for x in own) for own in found] for k in range(n_base)]
        base = [_digest([x for x in own if x[1] < n_base], rules) for own in found]
        clean = [t if not own else redacted(t, [(s, e) for s, _, e in own], mark) for t, own in zip(part.column(1).to_pylist(), found, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                part.column(0),
                *(pa.array(c, pa.int64()) for c in counts),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]),
                pa.array([_digest(own, rules) for own in found]),
                pa.array(map(len, found), pa.int64()),
                pa.array(clean, pa.string()),
                *part.columns[2:],
            ],
            names=[*own_names, *carried],
        )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long, clean_text string"
    own_names = [c.split()[0] for c in schema.split(", ")]
    carried = [f"carried_{c}" if c in own_names else c for c in carry]
    schema += "".join(f", `{name}` {docs.schema[c].dataType.simpleString()}" for c, name in zip(carry, carried, strict=True))
    held = (F.col(c).alias(f"held_{k}") for k, c in enumerate(carry))
    return text_column(docs, id_col, text_col, *held).mapInArrow(per_slice(run), schema)
