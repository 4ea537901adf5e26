"""N-gram Jaccard join by prefix trees of globally ordered shingle sets.

Shingles have one global order: rare ones first, then by hash. How frequent a shingle
is comes from a sketch of fixed size over all documents. Two sets can be similar only
if they share one of their first shingles (the prefix filter), so:

1. Equal sets are one class, represented by its least document. Shingles that the same
   documents hold in their prefixes are one group.
2. First each class meets only the least class of each of its groups (its head), which
   takes as many comparisons as there are classes, however large a group of near copies
   is. Verified links give components.
3. Groups that still hold several components are joined by a trie each. Of each set the
   groups from the shared one on are stored in global order, every common beginning once
   (shingles that no other set has in its prefix can't match, and need no node). Sets walk
   down the trie together and share the overlap of each beginning; a subtree is left as
   soon as all of it belongs to the set's component, or its sizes and what remains of the
   prefixes can't reach the threshold.
4. Pairs left are told apart by marks of their sets, 256 bytes each, as far as those can.
   What then is left is verified on whole sets, sorted below their head as another trie.

Only prefixes are shuffled for all documents; whole sets only for candidates that marks
don't tell apart. Shingles
that the sketch finds frequent are grouped by partial aggregation and joined back; the
members of a hot group or head are dealt to as many tasks as they need, in pairs of
blocks, each with its own trie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import ragged
from .shared import components, forget, meeting, written
from .words import Words, rolling, sliced, text_column

SKETCH_BITS = 18
_BLOCK = 4096
#: Members of a head in one trie.
TRIE_MEMBERS = 4096
#: Groups on a path. Sets that are still alike then are compared as a whole.
NAMED = 16
#: Groups before that go with a path: pairs that share one of them have met there.
BEFORE = 8
#: Sets walk a trie together as long as they have so many partners in all, or one alone.
PARTNERS = 1 << 20
#: Bits of a set's mark. In sets of many more shingles all are set, and such pairs are compared as a whole.
MARK_BITS = 2048


def shingles(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text. A shorter text is one shingle; one without words has none."""
    words = Words(texts, lower_ascii=True)
    hashes = words.hashes()
    for a, b in zip(words.bounds, words.bounds[1:], strict=False):
        own = hashes[a:b]
        if len(own) >= width:
            yield np.unique(rolling(own, width))
        else:
            yield rolling(own, len(own)) ^ np.uint64(len(own)) if len(own) else np.zeros(0, np.uint64)


def _surveyed(width: int):
    """Rows of two kinds: each document's set size and hash; and at last the blocks of the frequency sketch."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "n", "set_hash", "set_hash2", "block", "counts"]

        def rows(ids, n, h1, h2, block, raw):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(block, pa.int32()), pa.array(raw, pa.binary())], names=names)

        for part in sliced(batches):
            n, one, two = [], [], []
            for own in shingles(part.column(1), width):
                counts += np.bincount(own.astype(np.int64) & ((1 << SKETCH_BITS) - 1), minlength=1 << SKETCH_BITS) if len(own) > 50_000 else 0
                if len(own) <= 50_000:
                    np.add.at(counts, (own & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), 1)
                raw = own.tobytes()
                n.append(len(own))
                one.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                two.append(xxhash.xxh3_64_intdigest(raw, 1) - (1 << 63))
            none = [None] * part.num_rows
            yield rows(part.column(0), n, one, two, none, none)
        if counts.any():
            blocks = counts.reshape(-1, _BLOCK)
            none = [None] * len(blocks)
            yield rows(none, none, none, none, np.arange(len(blocks)), [b.tobytes() for b in blocks])

    return over


def _added(own: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(_BLOCK, np.int64)
    for raw in own["counts"]:
        total += np.frombuffer(raw, np.int64)
    return pd.DataFrame({"block": [own["block"].iat[0]], "counts": [total.tobytes()]})


def levels(counts: np.ndarray) -> np.ndarray:
    """0 for the sketch's ordinary cells, up to 7 for those twice, four times, ... as full as usual."""
    usual = max(8.0, 2.0 * float(np.median(counts)))
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / usual)) + 1, 0, 7).astype(np.uint64)


def ordered(own: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A set as sorted numbers whose order is the global order: level, then hash."""
    cell = (own & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)
    return np.unique((level[cell] << np.uint64(60)) | (own >> np.uint64(4)))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _prefixes(width: int, percent: int, level):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            ids, tokens, docs, places = part.column(0).to_numpy(), [], [], []
            for doc, own in zip(ids, shingles(part.column(1), width), strict=True):
                first = ordered(own, level.value)[: prefix_size(len(own), percent)]
                tokens.append(first.view(np.int64))
                docs.append(np.full(len(first), doc))
                places.append(np.arange(len(first), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, docs, places)], names=["token", "doc_id", "place"])

    return over


def _sets(width: int, level):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            own = [ordered(x, level.value).astype(">u8").tobytes() for x in shingles(part.column(1), width)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], names=["doc_id", "set"])

    return over


def mark(own: np.ndarray) -> bytes:
    """Which cells, of ``MARK_BITS``, a set has shingles in."""
    cells = np.zeros(MARK_BITS, bool)
    cells[(own >> np.uint64(30)).astype(np.int64) & (MARK_BITS - 1)] = True
    return np.packbits(cells).tobytes()


def _marks(width: int, level):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            own = [ordered(x, level.value) for x in shingles(part.column(1), width)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([mark(x) for x in own], pa.binary())], names=["doc_id", "n", "mark"])

    return over


def _unlike(percent: int):
    """Leaves out pairs whose marks show that they can't link: in each cell that one set alone is in lies a shingle that the other lacks."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(k).to_numpy() for k in (2, 4))
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, MARK_BITS // 64) for k in (3, 5))
                both = np.minimum(n - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), m - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
                good = pa.array(similar(n, m, both, percent))
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in (0, 1)], names=["head", "doc_id"])

    return over


def similar(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


class TrieWalk:
    """Overlaps of one head's set with sets that come in sorted order."""

    STEP = 64

    def __init__(self, head: np.ndarray, percent: int):
        self.head, self.percent = head, percent
        self.before = np.zeros(0, np.uint64)
        #: Overlap after each token of the path to the current node.
        self.path = np.zeros(1, np.int64)
        #: Depth at which the current path was given up, or None.
        self.pruned: int | None = None

    def links(self, own: np.ndarray) -> bool:
        limit = min(len(own), len(self.before))
        differ = np.flatnonzero(own[:limit] != self.before[:limit])
        shared = int(differ[0]) if len(differ) else limit
        self.before = own
        if self.pruned is not None and shared >= self.pruned and self._hopeless(self.pruned, len(own)):
            return False
        at = min(shared, len(self.path) - 1)
        path, self.pruned = [self.path[: at + 1]], None
        overlap = int(self.path[at])
        while at < len(own):
            step = own[at : at + self.STEP]
            found = np.searchsorted(self.head, step)
            hit = self.head[np.minimum(found, len(self.head) - 1)] == step
            path.append(overlap + np.cumsum(hit))
            overlap, at = int(path[-1][-1]), at + len(step)
            if not self._reachable(overlap, at, own):
                self.path, self.pruned = np.concatenate(path), at
                return False
        self.path = np.concatenate(path)
        return similar(len(self.head), len(own), overlap, self.percent)

    def _reachable(self, overlap: int, at: int, own: np.ndarray) -> bool:
        left = len(self.head) - int(np.searchsorted(self.head, own[at - 1], "right"))
        return similar(len(self.head), len(own), overlap + min(left, len(own) - at), self.percent)

    def _hopeless(self, depth: int, size: int) -> bool:
        """Whether no set of this size below the pruned node can be similar."""
        left = len(self.head) - int(np.searchsorted(self.head, self.before[depth - 1], "right"))
        return not similar(len(self.head), size, int(self.path[depth]) + min(left, size - depth), self.percent)


def _walked(percent: int):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, walk = None, None
        for batch in batches:
            heads, salts, docs, sets = (batch.column(i).to_pylist() for i in (0, 1, 2, 3))
            found = []
            for head, salt, doc, raw in zip(heads, salts, docs, sets, strict=True):
                own = np.frombuffer(raw, ">u8").astype(np.uint64)
                if doc is None:
                    key, walk = (head, salt), TrieWalk(own, percent)
                elif key == (head, salt) and walk.links(own):
                    found.append((head, doc))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["u", "v"])

    return over


def enough(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """How much two prefixes must share, see ``promising``."""
    return np.maximum(1, -(-percent * (n + m) // (100 + percent)) + 1 + -percent * np.maximum(n, m) // 100)


class Trie:
    """Sorted paths of sets, each beginning stored once, with bounds of what lies below each node.

    A path starts with a number that stands for the group its sets share, and goes on with the other groups of the
    set's prefix in global order; a group weighs as many shingles as it stands for.
    """

    def __init__(self, paths: list[list[int]], weights: list[list[int]], total: np.ndarray, n: np.ndarray, reach: np.ndarray, label: np.ndarray):
        """``total``: what all groups of a set weigh, those behind the end of its path included."""
        token, weight, parent, depth, end, before, nodes = [0], [0], [0], [0], [], [], [0]
        for own, weigh in zip(paths, weights, strict=True):
            shared, limit = 0, min(len(own), len(before))
            while shared < limit and own[shared] == before[shared]:
                shared += 1
            del nodes[shared + 1 :]
            parent.append(nodes[-1])
            nodes.extend(range(len(token), len(token) + len(own) - shared))
            parent.extend(nodes[shared + 1 : -1])
            if shared == len(own):
                parent.pop()
            token.extend(own[shared:])
            weight.extend(weigh[shared:])
            depth.extend(range(shared + 1, len(own) + 1))
            end.append(nodes[-1])
            before = own
        token, self.weight, parent, depth, self.end = (np.array(x, np.int64) for x in (token, weight, parent, depth, end))
        count, big = len(token), np.iinfo(np.int64).max
        self.least, self.most, self.rest, self.low, self.high = np.full(count, big), np.zeros(count, np.int64), np.zeros(count, np.int64), np.full(count, big), np.full(count, -big)
        self.reach = np.zeros(count, np.int64)
        bounds = ((self.reach, reach, np.maximum), (self.least, n, np.minimum), (self.most, n, np.maximum), (self.rest, total, np.maximum), (self.low, label, np.minimum), (self.high, label, np.maximum))
        for bound, value, by in bounds:
            by.at(bound, self.end, value)
        order = np.argsort(depth, kind="stable")
        layers = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        for some in layers[:0:-1]:
            for bound, _, by in bounds:
                by.at(bound, parent[some], bound[some])
        read = np.zeros(count, np.int64)
        for some in layers[1:]:
            read[some] = read[parent[some]] + self.weight[some]
        #: What a set below can still add behind the node.
        self.rest -= read
        self.behind = total - read[self.end]
        self.alphabet, self.code = np.unique(token, return_inverse=True)
        self.children = np.argsort(parent[1:], kind="stable") + 1
        self.starts = np.searchsorted(parent[self.children], np.arange(count + 1))
        self.ends = np.argsort(self.end, kind="stable")
        self.end_starts = np.searchsorted(self.end[self.ends], np.arange(count + 1))

    @staticmethod
    def _below(starts: np.ndarray, nodes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into nodes, value) of all values that belong to the nodes."""
        sizes = starts[nodes + 1] - starts[nodes]
        return np.repeat(np.arange(len(nodes)), sizes), values[ragged(starts[nodes], sizes)]

    def near(self, paths: list[list[int]], weights: list[list[int]], total: np.ndarray, n: np.ndarray, reach: np.ndarray, label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probe, path, share): sets of the same first group and other labels, and the most that they can share with a probe."""
        # Odd numbers are groups of the trie, even ones lie between them; one sorted array for all probes.
        wide = 2 * len(self.alphabet) + 2
        sizes = np.array([len(x) for x in paths], np.int64)
        flat = np.fromiter((t for x in paths for t in x), np.int64, sizes.sum())
        place = np.searchsorted(self.alphabet, flat)
        exact = self.alphabet[np.minimum(place, len(self.alphabet) - 1)] == flat
        keys = np.r_[np.repeat(np.arange(len(paths)), sizes) * wide + 2 * place + exact, len(paths) * wide]
        read = np.r_[0, np.cumsum(np.fromiter((t for x in weights for t in x), np.int64, sizes.sum()))]
        begin = np.cumsum(sizes) - sizes
        probe = np.arange(len(paths))
        # To the probe's own group.
        groups = self.children[: self.starts[1]]
        number = {int(self.alphabet[c]): int(g) for c, g in zip(self.code[groups], groups, strict=True)}
        node = np.array([number.get(x[0], 0) for x in paths], np.int64)
        probe = probe[node > 0]
        node = node[node > 0]
        whole = read[begin] + total
        overlap, left = self.weight[node], whole[probe] - read[begin[probe] + 1]
        found = [(np.zeros(0, np.int64),) * 3]
        while len(node):
            size, low, high = n[probe], self.least[node], self.most[node]
            # The least that a size in low .. high asks for is asked at its ends; one less for rounding.
            smaller = np.clip(np.maximum(low, percent * size // 100), None, size)
            larger = np.clip(np.minimum(high, 100 * size // percent + 1), size, None)
            asked = np.minimum(np.where(low <= size, enough(size, smaller, percent), 1 << 40), np.where(high >= size, enough(size, larger, percent), 1 << 40)) - 1
            good = (overlap + np.minimum(left, self.rest[node]) >= asked) & ((100 + percent) * np.minimum(reach[probe], self.reach[node]) >= percent * (size + np.minimum(size, smaller))) & (100 * high >= percent * size) & (percent * low <= 100 * size)
            good &= (self.low[node] != label[probe]) | (self.high[node] != label[probe])
            probe, node, overlap, left = probe[good], node[good], overlap[good], left[good]
            i, path = self._below(self.end_starts, node, self.ends)
            found.append((probe[i], path, overlap[i] + np.minimum(left[i], self.behind[path])))
            i, node = self._below(self.starts, node, self.children)
            probe, overlap = probe[i], overlap[i]
            wanted = probe * wide + 2 * self.code[node] + 1
            at = np.searchsorted(keys, wanted)
            hit = keys[at] == wanted
            left = whole[probe] - read[at + hit]
            # Behind the end of a path that isn't whole anything can match.
            hit |= (at == begin[probe] + sizes[probe]) & (left > 0)
            overlap = overlap + hit * self.weight[node]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def met_before(x: np.ndarray, y: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether the sets of each pair share one of the groups ``before``, of which there is one row for each set, filled up with -1."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), 1 << 16):
        a, b = before[x[at : at + (1 << 16)]], before[y[at : at + (1 << 16)]]
        for k in range(before.shape[1]):
            out[at : at + (1 << 16)] |= ((b == a[:, k : k + 1]) & (b >= 0)).any(1)
    return out


def _met(percent: int):
    """Pairs of each block of a group's sets; rows come sorted by block, side and path. Small blocks are taken together.

    A pair meets in each group that its sets share, but only the first can't be told to be lost: there, all that they
    share is still ahead. So pairs known to have met in a group before are left to that.
    """

    def pairs(own: list[tuple]) -> pa.RecordBatch:
        side, doc, label, n, reach, total = (np.array([r[k] for r in own], np.int64) for k in range(1, 7))
        block = np.array([r[0] for r in own], np.int64)
        paths, weights = [[-r[0], *r[8]] for r in own], [[r[7], *r[9]] for r in own]
        before = np.full((len(own), BEFORE), -1, np.int64)
        for k, r in enumerate(own):
            before[k, : len(r[10])] = r[10]
        # A block with one side meets itself.
        alone = np.bincount(block, side)[block] == 0
        left, right = np.flatnonzero(side == 0), np.flatnonzero(alone | (side == 1))
        found = [np.zeros((2, 0), np.int64)]
        trie = Trie([paths[k] for k in right], [weights[k] for k in right], total[right], n[right], reach[right], label[right])
        # As many probes at once as have so many partners.
        meets = np.cumsum(np.bincount(block[right], minlength=block.max() + 1)[block[left]])
        for some in np.split(left, np.unique(np.searchsorted(meets, np.arange(PARTNERS, meets[-1] + 1, PARTNERS)))):
            probe, path, shared = trie.near([paths[k] for k in some], [weights[k] for k in some], total[some], n[some], reach[some], label[some], percent)
            x, y = some[probe], right[path]
            good = (shared >= enough(n[x], n[y], percent)) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (label[x] != label[y])
            good &= (~alone[x] | (label[x] < label[y])) & ((100 + percent) * np.minimum(reach[x], reach[y]) >= percent * (n[x] + n[y]))
            x, y = x[good], y[good]
            new = ~met_before(x, y, before)
            found.append(np.stack([doc[x[new]], doc[y[new]]]))
        both = np.unique(np.sort(np.concatenate(found, 1), 0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["head", "doc_id"])

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, own = None, 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    if len(own) >= TRIE_MEMBERS:
                        yield pairs(own)
                        number, own = 0, []
                    key, number = row[:3], number + 1
                own.append((number, *row[3:12], row[12] if len(row) > 12 else ()))
        if own:
            yield pairs(own)

    return over


def needed(n, m, percent: int):
    """How much sets of ``n`` and ``m`` shingles must share."""
    n, m = (F.col(x) if isinstance(x, str) else x for x in (n, m))
    return F.ceil((n + m) * percent / F.lit(100 + percent))


def lacking(n, m, percent: int):
    """How much of that their prefixes must share, see ``promising``."""
    n, m = (F.col(x) if isinstance(x, str) else x for x in (n, m))
    need = needed(n, m, percent)
    rest = F.ceil(F.greatest(n, m) * percent / F.lit(100)) - 1
    return F.greatest(F.lit(1), need - rest)


def promising(n: str, m: str, shared: str, percent: int):
    """Whether sets of ``n`` and ``m`` shingles can be similar if their prefixes share ``shared``.

    Similar sets share at least ``a = percent (n + m) / (100 + percent)``. Take the set
    whose prefix ends first in the global order: all of it that the other set also holds
    up to there has been counted, and behind its prefix it has ``ceil(percent n / 100) - 1``
    more. The larger set has the larger rest, so its rest bounds both cases.
    """
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.col(shared) >= lacking(n, m, percent))


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, level) -> DataFrame:
    """Of (head, doc_id), the links, as a written table (u, v)."""
    pairs = written(pairs.select("head", "doc_id"), "set-pairs")
    wanted, marks = _of_sets(pairs, docs, _marks(width, level), "n long, mark binary", "marks")
    members, roots = _dealt(pairs, marks, "n", "mark")
    likely = members.join(roots.select("head", "salt", F.col("n").alias("m"), F.col("mark").alias("other")), ["head", "salt"]).select("head", "doc_id", "n", "mark", "m", "other")
    likely = written(likely.mapInArrow(_unlike(percent), "head long, doc_id long"), "likely-pairs")
    forget(pairs, wanted, marks)
    wanted, sets = _of_sets(likely, docs, _sets(width, level), "set binary", "sets")
    members, roots = _dealt(likely, sets, "set")
    order = ["head", "salt", F.col("doc_id").isNotNull(), "set"]
    links = written(members.union(roots).repartition("head", "salt").sortWithinPartitions(*order).mapInArrow(_walked(percent), "u long, v long"), "links")
    forget(likely, wanted, sets)
    return links


def _of_sets(pairs: DataFrame, docs: DataFrame, what, columns: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The documents in pairs, and what ``what`` makes of each; both written."""
    wanted = written(pairs.select("doc_id").union(pairs.select("head")).distinct(), "candidates")
    made = meeting(docs, wanted, "doc_id", how="left_semi").mapInArrow(what, f"doc_id long, {columns}").dropDuplicates(["doc_id"])
    return wanted, written(made, name)


def _dealt(pairs: DataFrame, made: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Members of each head and the heads themselves (without doc_id), (head, salt, doc_id, columns), in as many parts of a head as it needs."""
    salts = pairs.groupBy("head").agg(F.ceil(F.count("*") / F.lit(TRIE_MEMBERS)).cast("int").alias("salts"))
    members = pairs.join(salts, "head").select("head", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), "doc_id").join(made, "doc_id").select("head", "salt", "doc_id", *columns)
    roots = salts.join(made, salts["head"] == made["doc_id"]).select("head", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("doc_id"), *columns)
    return members, roots


def _token_groups(tokens: DataFrame) -> DataFrame:
    """(token, doc_id, head, place, times): documents by the prefix tokens that two of them share, head being the least, place how many of its tokens come before.

    Tokens held by the same documents say the same: the least of them stands for all ``times`` of them. Such
    sets of documents are told apart by the least and the greatest of them and 112 bits of hashes.
    """
    rare = tokens.where(F.shiftright("token", 60) == 0)
    hot = tokens.where(F.shiftright("token", 60) > 0)
    # Sums besides the exclusive or, in which rows that repeat an id would vanish.
    part = lambda *more: F.sum(F.shiftrightunsigned(F.xxhash64("doc_id", *more), 40))
    what = {"head": F.min("doc_id"), "last": F.max("doc_id"), "one": F.bit_xor(F.xxhash64("doc_id")), "two": part(), "three": part(F.lit(1))}
    group = Window.partitionBy("token")
    rare = rare.select("token", "doc_id", "place", *(x.over(group).alias(k) for k, x in what.items())).where("head <> last")
    of_hot = hot.groupBy("token").agg(*(x.alias(k) for k, x in what.items())).where("head <> last")
    rows = rare.union(hot.join(of_hot, "token").select(rare.columns))
    return rows.groupBy("one", "two", "three", "head", "last", "doc_id").agg(F.min("token").alias("token"), F.min("place").alias("place"), F.count("*").alias("times")).select("token", "doc_id", "head", "place", "times")


def jaccard_join(docs: DataFrame, *, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    A-Z are lower-cased. A text of fewer than ``width`` words is one shingle; null texts
    and texts without words have none and link with nothing. Documents link if their
    intersection is at least ``percent`` of their union (a tie links); a component is named
    by its least document. Rows without an id are counted and link with nothing, so that
    their component is null. Rows that repeat an id and text give repeated rows. A text of
    any length is read whole. Other columns, whatever their names, are not read. An empty
    table gives an empty result. Shingles are told apart by 60 bits of a hash, whole sets
    by 128.
    """
    spark = docs.sparkSession
    read = text_column(docs, id_col, text_col)
    survey = written(read.mapInArrow(_surveyed(width), "doc_id long, n long, set_hash long, set_hash2 long, block int, counts binary"), "survey")
    sketch = np.zeros((1 << SKETCH_BITS) // _BLOCK * _BLOCK, np.int64)
    for row in survey.where("block is not null").select("block", "counts").groupBy("block").applyInPandas(_added, "block int, counts binary").collect():
        sketch[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.counts, np.int64)
    level = spark.sparkContext.broadcast(levels(sketch))
    known = survey.where("block is null").select("doc_id", "n", "set_hash", "set_hash2")
    # Equal sets: the least document stands for all.
    named = known.where("n > 0 and doc_id is not null")
    classes = written(named.groupBy("set_hash", "set_hash2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("times")).where("times > 1").drop("times"), "classes")
    copies = written(named.join(classes, ["set_hash", "set_hash2"]).where("doc_id <> rep").select("doc_id", "rep").distinct(), "copies")
    sizes = meeting(named.select("doc_id", "n"), copies, "doc_id", how="left_anti").dropDuplicates(["doc_id"])
    reps = meeting(read.where("doc_id is not null"), copies, "doc_id", how="left_anti")

    tokens = written(reps.mapInArrow(_prefixes(width, percent, level), "token long, doc_id long, place int"), "prefixes")
    groups = written(_token_groups(tokens), "token-groups")
    # Each with the head of its groups, if it shares enough with it. What this misses is left to the next step.
    first = groups.where("doc_id <> head").groupBy("head", "doc_id").agg(F.sum("times").alias("shared"), F.min("place").alias("place")).join(sizes, "doc_id")
    first = first.join(sizes.select(F.col("doc_id").alias("head"), F.col("n").alias("m")), "head").where(promising("n", "m", "shared", percent) & (F.col("n") - F.col("place") >= needed("n", "m", percent)))
    forget(tokens)
    links = _verified(first, reps, width, percent, level)
    label = written(components(links), "labels")

    # Groups that still hold several components: a trie for each.
    named = groups.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(sizes, "doc_id").select("token", "times", "place", "doc_id", "n", F.coalesce("component", "doc_id").alias("label"))
    named = written(named, "labelled-groups")
    apart = named.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("sets")).where("a <> b").drop("a", "b")
    apart = written(apart, "apart")
    # With what is known of each group, so that the longer rows of paths needn't be joined with it.
    of_doc = named.join(apart, "token").groupBy("doc_id", "label", "n").agg(F.sort_array(F.collect_list(F.struct("token", F.col("times").cast("long").alias("times"), "place", "sets", "least", "most"))).alias("own"))
    # From each group on, what the set still holds. What comes before is lost to all that meet first there; sets that
    # then can't share enough with a set of any size there is are left.
    paths = of_doc.select("doc_id", "label", "n", F.posexplode("own").alias("k", "g"), "own").select("doc_id", "label", "n", "g.*", F.slice("own", F.col("k") + 2, F.greatest(F.lit(0), F.size("own") - F.col("k") - 1)).alias("path"), F.slice("own", F.greatest(F.lit(1), F.col("k") + 1 - BEFORE), F.least("k", F.lit(BEFORE))).alias("before"))
    known_of = ["token", "sets", "least", "most", "doc_id", "label", "n"]
    paths = paths.select(*known_of, (F.col("n") - F.col("place")).alias("reach"), "times", F.transform("before", lambda g: g["token"]).alias("before"), F.transform("path", lambda g: g["token"]).alias("path"), F.transform("path", lambda g: g["times"]).alias("weights"))
    # All that it still holds counts, the next groups are named: those are enough to tell most sets apart.
    weighed = F.aggregate("weights", F.lit(0).cast("long"), lambda a, b: a + b)
    paths = paths.select(*known_of, "reach", (F.col("times") + weighed).alias("total"), "times", F.slice("path", 1, NAMED).alias("path"), F.slice("weights", 1, NAMED).alias("weights"), "before")
    total = F.col("total")
    smaller, larger = F.least("n", F.greatest("least", F.floor(F.col("n") * percent / 100))), F.greatest("n", F.least("most", F.floor(F.col("n") * 100 / percent) + 1))
    never = F.lit(1 << 40)
    asked = F.least(F.when(F.col("least") <= F.col("n"), lacking("n", smaller, percent)).otherwise(never), F.when(F.col("most") >= F.col("n"), lacking("n", larger, percent)).otherwise(never)) - 1
    branches = paths.where((total >= asked) & (F.col("reach") >= needed("n", F.least("n", smaller), percent)))
    branches = branches.withColumn("blocks", F.ceil(F.col("sets") / TRIE_MEMBERS).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # Block i meets each block j >= i once: as side 0 where it is the lower, as side 1 where it is the higher.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("low"), F.greatest("own", j).alias("high"), (F.col("own") > j).cast("int").alias("side")))
    rows = ["doc_id", "label", "n", "reach", "total", "times", "path", "weights", "before"]
    dealt = branches.select("token", *rows, F.explode(meets).alias("m")).select("token", "m.low", "m.high", "m.side", *rows)
    met = dealt.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "side", "path").mapInArrow(_met(percent), "head long, doc_id long").distinct()
    more = _verified(met, reps, width, percent, level)
    forget(groups, label, named, apart)
    label = written(components(links.union(more)), "labels")
    of_rep = copies.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    of_all = written(label.select(F.col("node").alias("doc_id"), "component").union(of_rep), "components")
    forget(links, more, label)
    return known.join(of_all, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
