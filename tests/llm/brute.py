"""The contracts' definitions, spelt out."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    told = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
    return *(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(told.encode()).hexdigest(), told


class Groups:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def unite(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def shingles(text, width=5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def jaccard(texts, width=5, percent=75):
    sets, groups = {d: shingles(t, width) for d, t in texts.items()}, Groups()
    holders = defaultdict(list)
    for d, own in sets.items():
        shared = Counter(e for g in own for e in holders[g])
        for e, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[e]) - n):
                groups.unite(d, e)
        for g in own:
            holders[g].append(d)
    return {d: (len(s), groups.find(d)) for d, s in sets.items()}


def substrings(texts, window=50):
    split, first = {d: words(t) for d, t in texts.items()}, {}
    for d in sorted(split):
        for i in range(len(split[d]) - window + 1):
            first.setdefault(tuple(split[d][i : i + window]), d)
    out = {}
    for d, w in split.items():
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def edits(a, b, most):
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return False
    return row[-1] <= most


def symbols(line):
    """(whether words are the symbols, the symbols)."""
    by_word = line.split(" ")
    return (True, by_word) if len(by_word) >= 8 and len(line.encode()) <= 2 * len(line) else (False, list(line))


def edits_allowed(by_word, n):
    return sum(n >= s for s in ((8, 24, 48) if by_word else (20, 40, 80)))


def near_lines(a, b):
    (wa, x), (wb, y) = symbols(a), symbols(b)
    most = edits_allowed(wa, min(len(x), len(y)))
    return a == b or wa == wb and most > 0 and edits(x, y, most)


def lines(texts):
    """The text kept of each document: every line against every line before it."""
    order = [(d, n, x) for d in sorted(d for d in texts if d is not None) if texts[d] is not None for n, x in enumerate(texts[d].split("\n")) if x.strip(" \t\r\x0b\x0c")]
    gone, before = set(), {}
    for d, n, x in order:
        if x in before or any(abs(len(o) - len(x)) <= 3 * max(map(len, o.split(" ") + x.split(" "))) + 3 and near_lines(o, x) for o in before):
            gone.add((d, n))
        before[x] = None
    return {d: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in texts.items()}


def pieces(ids_by_doc, most):
    out = {}
    for d, ids in ids_by_doc.items():
        own = [*ids, 0]
        for k, start in enumerate(range(0, len(own), most)):
            cut = own[start : start + most]
            out[d, k] = (start, len(cut), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in cut)))
    return out


def cosine_links(vectors, threshold):
    """vectors: id -> (label, list). (links, component) of each id."""
    groups, n = Groups(), Counter()
    good = {i: (lab, v) for i, (lab, v) in vectors.items() if lab is not None and v and all(x is not None and x == x and abs(x) != float("inf") for x in v) and any(v)}
    ids = sorted(good)
    for p, i in enumerate(ids):
        for j in ids[p + 1 :]:
            (la, a), (lb, b) = good[i], good[j]
            if la == lb and len(a) == len(b) and sum(x * y for x, y in zip(a, b, strict=True)) >= threshold * sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5:
                groups.unite(i, j)
                n[i] += 1
                n[j] += 1
    return {i: (n[i], groups.find(i)) for i in vectors}


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and abs(x) < float("inf") for x in v) and any(v)


def nearest(vectors, query, k):
    """The k nearest of {id: vector} to the vector of one id: (id, cosine), equal cosines by id."""
    import math

    cos = lambda a, b: math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a)) / math.sqrt(math.fsum(x * x for x in b))  # noqa: E731,B905
    own = vectors[query]
    found = [(-cos(own, v), i) for i, v in vectors.items() if i != query and len(v) == len(own)]
    return [(i, -c) for c, i in sorted(found)[:k]]


def clusters(rows, width=64, clusters=40, rounds=5, scale=256, seed=2):
    """[(id, cluster, distance, inertia of the cluster, of all, digest)] of [(id, vector)]."""
    import math

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and abs(x) < float("inf") for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    centroids = [v for _, v in first]

    def assigned():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = assigned()
        for k in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = assigned() if centroids else []
    of = Counter()
    for d, k in own:
        of[k] += d
    return sorted(((i, k, d, of[k], sum(of.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, own, strict=True)), key=repr)


def alignments(texts, first, second, a_bytes, b_bytes):
    """{place: (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)} of [text]; ``first`` and ``second`` code a text, the others give an id's bytes."""
    told, linked = [], []
    for text in texts:
        text = text or ""
        a, b = (first(" " + text), second(text)) if text else ([], [])
        if b"".join(map(a_bytes, a)) != (" " + text).encode() or b"".join(map(b_bytes, b)) != (" " + text).encode():
            a = b = []
        ends = lambda ids, of: list(itertools.accumulate(len(of(x)) for x in ids))
        a_ends, b_ends = ends(a, a_bytes), ends(b, b_bytes)
        groups, i, j = [], 0, 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            groups.append((a[i : a_ends.index(cut, i) + 1], b[j : b_ends.index(cut, j) + 1]))
            i, j = i + len(groups[-1][0]), j + len(groups[-1][1])
        told.append((len(a), len(b), groups))
        linked.append(Counter((x, y) for left, right in groups for x in left for y in right))
    counts = Counter(pair for own in linked for pair in own)
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = {}
    for i, ((n_a, n_b, groups), own) in enumerate(zip(told, linked, strict=True)):
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out[i] = (n_a, n_b, len(groups), sum(own.values()), sum(n for p, n in own.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if text else "")
    return out
