"""Toxicity by a support vector machine on a string subsequence kernel with Nyström landmarks.

A text is read as sentences of units: words in lower case without punctuation, where runs
of single letters ("i d i o t") are one unit more. Two units are as alike as the
subsequences of four characters they share, each weighted by ``DECAY`` to the power
of the stretch it takes, so that gaps and inserted characters cost a little instead of
everything; this is divided by what units of their lengths could reach. An insult is a unit
among many, so a sentence is as toxic as the units in it that are most.

The machine is trained on sentences that carry their row's label, as a multiple-instance
machine: of a toxic row some unit must lie on the toxic side, of a clean row none may. It starts
from all suspects of the toxic rows, the units most like one of the landmarks; then, again and
again, only those that the machine itself puts on the toxic side (the best one of a row at
least) stand for the row, against all suspects of clean rows. Landmarks are the units that tell
toxic rows from clean ones best, and common ones.

Because the kernel is a sum over subsequences, the trained machine is one table of weights
over subsequences: a unit looks up its own, and gets the same margin as by the kernel with
every landmark. A text is scored by its best sentences, through a logistic curve fitted on the
labelled rows.

Training reads a bounded, documented sample of labelled rows; scoring reads every
row once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import ragged
from .shared import forget, written
from .words import Words, per_slice, sliced, text_column

#: Characters that are told apart; any other letter or digit is the last one.
ALPHABET = "^abcdefghijklmnopqrstuvwxyzéèêçäöüßñóíáúàâîôû0?"
ORDER, DECAY, STRETCH = 4, 0.5, 7
#: Longer units are read as overlapping parts of so many characters, the mark for the start included.
LONGEST = 24
#: Log-likelihood ratio from which a unit is a landmark of toxic rows (beyond chance for one in some thousands of units).
TELLING = 14.0
#: Cost of a unit on the wrong side.
COST = 0.1
#: Rows that training turns to double precision at once.
BLOCK = 4096
#: Words of a sentence that no mark ends.
SENTENCE = 32
_SIZE = len(ALPHABET) + 1
_CODE = {c: i for i, c in enumerate(ALPHABET)}


def unit_of(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalnum())


def coded(unit: str) -> np.ndarray:
    """The unit's characters as numbers, after a mark for its start."""
    return np.array([0] + [_CODE["0"] if c.isdigit() else _CODE.get(c, _CODE["?"]) for c in unit], np.int64)


@cache
def _picks(length: int) -> tuple[np.ndarray, np.ndarray]:
    """All index tuples of subsequences within STRETCH, and their weights, scaled to norm 1."""
    rows = [(i, *rest) for i in range(length) for rest in combinations(range(i + 1, min(length, i + STRETCH)), ORDER - 1)]
    at = np.array(rows, np.int64).reshape(-1, ORDER)
    weight = DECAY ** (at[:, -1] - at[:, 0] + 1) if len(at) else np.zeros(0)
    return at, weight / max(1e-12, np.sqrt((weight**2).sum()))


def features(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(subsequence numbers per unit, weights) for units of one length, coded as rows."""
    at, weight = _picks(units.shape[1])
    number = np.zeros((len(units), len(at)), np.int64)
    for k in range(ORDER):
        number = number * _SIZE + units[:, at[:, k]]
    return number, weight


def kernel(a: str, b: str) -> float:
    """The kernel of two units, term by term."""
    (na, wa), (nb, wb) = (features(coded(x)[None, :]) for x in (a, b))
    return float(sum(x * wb[nb[0] == n].sum() for n, x in zip(na[0], wa, strict=True)))


@dataclass
class Machine:
    """Weights over subsequences, a bias, and the logistic curve from what ``suspicion`` tells of a text to its score."""

    numbers: np.ndarray
    weights: np.ndarray
    bias: float
    curve: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(_SIZE**ORDER, np.float32)
        out[self.numbers] = self.weights
        return out


def unit_values(units: list[str], table: np.ndarray) -> np.ndarray:
    """What each unit finds in the table; one too short for a subsequence finds nothing."""
    out = np.zeros(len(units))
    by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, u in enumerate(units):
        if len(u) >= ORDER - 1:
            by_length.setdefault(len(u), []).append((i, coded(u)))
    for own in by_length.values():
        for at in range(0, len(own), 4096):
            some = own[at : at + 4096]
            number, weight = features(np.stack([x[1] for x in some]))
            out[[x[0] for x in some]] = table[number] @ weight.astype(np.float32)
    return out


@dataclass
class Sentences:
    """The sentences of a column of texts: for each place of a unit its number, its sentence; for each sentence its text and its size."""

    units: list[str]
    unit: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    size: np.ndarray


def _parts(unit: str) -> list[str]:
    """Units of at most LONGEST - 1 characters: overlapping parts of a longer one."""
    most = LONGEST - 1
    return [unit] if len(unit) <= most else [unit[k : k + most] for k in range(0, len(unit) - 8, most - 8)]


def sentences_of(words: Words) -> Sentences:
    """A sentence ends with a word that ends in a full stop, an exclamation or a question mark, or after SENTENCE words."""
    raw = [w.decode("utf-8", "replace") for w in words.unique.to_pylist()]
    whole = [unit_of(w) for w in raw]
    number: dict[str, int] = {}
    parts = [[number.setdefault(p, len(number)) for p in _parts(u)] for u in whole]
    codes, owner, n = words.codes, words.owner(), len(words)
    ends = np.fromiter((w[-1] in ".!?" for w in raw), bool, len(raw))[codes]
    single = np.fromiter((len(u) == 1 for u in whole), bool, len(whole))[codes]
    fresh = np.ones(n, bool)
    fresh[1:] = ends[:-1] | (owner[1:] != owner[:-1])
    begun = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    fresh |= (np.arange(n) - begun) % SENTENCE == 0
    sentence = np.cumsum(fresh) - 1
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat, starts = np.fromiter((x for p in parts for x in p), np.int64, sizes.sum()), np.cumsum(sizes) - sizes
    unit, of = flat[ragged(starts[codes], sizes[codes])], np.repeat(sentence, sizes[codes])
    # Single letters in a row spell one more unit.
    breaks = np.r_[True, owner[1:] != owner[:-1]] if n else np.zeros(0, bool)
    run = np.cumsum(breaks | np.r_[True, single[1:] != single[:-1]]) if n else np.zeros(0, np.int64)
    at = np.flatnonzero(single)
    edges = np.flatnonzero(np.r_[True, run[at][1:] != run[at][:-1]]) if len(at) else np.zeros(0, np.int64)
    more, more_of = [], []
    for a, b in zip(edges, np.r_[edges[1:], len(at)][: len(edges)], strict=True):
        if b - a >= ORDER - 1:
            spelt = [number.setdefault(p, len(number)) for p in _parts("".join(whole[c] for c in codes[at[a:b]]))]
            more += spelt
            more_of += [sentence[at[a]]] * len(spelt)
    unit, of = np.r_[unit, np.array(more, np.int64)], np.r_[of, np.array(more_of, np.int64)]
    count = int(sentence[-1]) + 1 if n else 0
    return Sentences(list(number), unit, of, owner[fresh], np.bincount(of, minlength=count))


def suspicion(words: Words, table: np.ndarray, bias: float) -> np.ndarray:
    """Of each text: how much its most toxic sentence holds, how much its three most toxic units are, each unit counted by a
    curve of its margin and each sentence up to 3, and the log of one more than its units, as long texts have more that look
    toxic by chance."""
    own, n = sentences_of(words), len(words.bounds) - 1
    weight = 1 / (1 + np.exp(np.clip(-6 * (unit_values(own.units, table) + bias), -30, 30)))
    sentence = np.minimum(np.bincount(own.sentence, weight[own.unit], len(own.text)), 3.0)
    best = np.zeros(n)
    np.maximum.at(best, own.text, sentence)
    wide = np.int64(len(own.units) + 1)
    both = np.unique(own.text[own.sentence] * wide + own.unit)
    text, weight = both // wide, weight[both % wide]
    count = np.bincount(text, minlength=n)
    starts, order, amount = np.cumsum(count) - count, np.lexsort((-weight, text)), np.zeros(n)
    for k in range(3):
        has = np.flatnonzero(count > k)
        amount[has] += weight[order[starts[has] + k]]
    return np.stack([best, amount, np.log1p(count)], 1)


def blocks(z: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """BLOCK rows at a time, in double precision and with a one behind each."""
    for at in range(0, len(z), BLOCK):
        own = slice(at, min(at + BLOCK, len(z)))
        yield own, np.c_[z[own].astype(float), np.ones(own.stop - at)]


def fit_svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the rows inside the margin. Beside ``z`` only a block of it is held."""
    w, ridge = np.zeros(z.shape[1] + 1), np.r_[np.ones(z.shape[1]), 1e-3]
    for _ in range(rounds):
        left, right = np.diag(ridge), np.zeros(len(w))
        for own, x in blocks(z):
            inside = y[own] * (x @ w) < 1
            xi, yi, ci = x[inside], y[own][inside], cost[own][inside]
            left = left + 2 * xi.T @ (ci[:, None] * xi)
            right = right + 2 * xi.T @ (ci * yi)
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new if _ < 5 else 0.5 * (w + new)
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve(x.T @ ((p * (1 - p))[:, None] * x) + 0.05 * np.eye(x.shape[1]), x.T @ (y - p) - 0.05 * w)
    return w


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def _unit_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, toxic texts, clean texts) of each slice."""
    for part in sliced(batches):
        own = sentences_of(Words(part.column(1)))
        both = np.unique(own.text[own.sentence] * np.int64(len(own.units) + 1) + own.unit)
        toxic = np.asarray(part.column(2)).astype(bool)[both // (len(own.units) + 1)]
        unit = both % (len(own.units) + 1)
        counts = [np.bincount(unit[side], minlength=len(own.units)) for side in (toxic, ~toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(own.units, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=["unit", "toxic", "clean"])


def _suspects(numbers: np.ndarray, nearest: np.ndarray, features_of: np.ndarray, most: int):
    """(toxic, rows): Nyström features (``features_of`` each subsequence number) of the units of each text that weigh most by ``nearest``."""
    tables: list[np.ndarray] = []

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables:
            tables.append(np.zeros(_SIZE**ORDER, np.float32))
            tables[0][numbers] = nearest
        for part in sliced(batches):
            own = sentences_of(Words(part.column(1)))
            alike = unit_values(own.units, tables[0])
            both = np.unique(own.text[own.sentence] * np.int64(len(own.units) + 1) + own.unit)
            text, unit = both // (len(own.units) + 1), both % (len(own.units) + 1)
            order = np.lexsort((-alike[unit], text))
            text, unit = text[order], unit[order]
            taken = np.arange(len(text)) - np.searchsorted(text, text) < most
            text, unit = text[taken], unit[taken]
            some, place = np.unique(unit, return_inverse=True)
            z = _against([own.units[u] for u in some], numbers, features_of).astype(np.float32)
            toxic = np.asarray(part.column(2))
            for i in np.unique(text):
                yield pa.RecordBatch.from_arrays([pa.array([int(toxic[i])], pa.int32()), pa.array([z[place[text == i]].tobytes()])], names=["toxic", "rows"])

    return over


def fit_sentences(rows: list[np.ndarray], toxic: np.ndarray, rounds: int = 5) -> tuple[np.ndarray, float]:
    """The machine, from the suspects of each text and the texts' labels."""
    x, text = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    positive = toxic[text] == 1
    y, margin = np.where(positive, 1.0, -1.0), np.zeros(len(x))
    stands, w, bias = positive.copy(), np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        n_toxic = max(1, int(stands.sum()))
        cost = COST * np.where(positive, max(1.0, (~positive).sum() / n_toxic / 4), 1.0)
        # What costs nothing has no part in the machine.
        w, bias = fit_svm(x, y, np.where(stands | ~positive, cost, 0.0))
        for own, some in blocks(x):
            margin[own] = some @ np.r_[w, bias]
        best = np.full(len(rows), -np.inf)
        np.maximum.at(best, text, margin)
        before, stands = stands, positive & ((margin > 0) | (margin >= best[text]))
        if (before == stands).all():
            break
    return w, bias


def train(docs: DataFrame, labels: DataFrame, *, max_toxic: int = 2000, max_clean: int = 4000, max_landmarks: int = 256, max_features: int = 128, max_suspects: int = 8) -> Machine | float:
    """Fit on at most ``max_toxic`` and ``max_clean`` labelled rows that aren't held out, picked by a hash of the id.

    The driver gets ``max_landmarks`` units, ``max_features`` numbers for each of at most ``max_suspects`` units of
    a sampled row, and three for the row. Where the labels hold one class only, or the
    texts no unit long enough, there is nothing to tell apart: then the smoothed share of toxic rows alone.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    picked = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, max_toxic), (0, max_clean))]
    sample = written(docs.where("text is not null").join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), "labelled-rows")
    sizes = dict(sample.groupBy("toxic").count().collect())
    share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 2)
    if len(sizes) < 2:
        return share
    counts = sample.mapInArrow(_unit_rows, "unit string, toxic long, clean long").where(F.length("unit") >= ORDER - 1)
    counts = counts.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # Which units are landmarks: those with the highest log-likelihood ratio of their toxic share, and the commonest others.
    base = sizes[1] / (sizes[0] + sizes[1])
    both, part = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    ratio = 2 * (F.col("toxic") * F.log(F.greatest(part, F.lit(1e-9)) / base) + F.col("clean") * F.log(F.greatest(1 - part, F.lit(1e-9)) / (1 - base)))
    counts = counts.select("unit", both.alias("n"), F.when(part > base, ratio).otherwise(-ratio).alias("ratio"))
    telling = counts.orderBy(F.desc("ratio"), F.desc("n"), "unit").limit(max_landmarks // 2).select("unit", "ratio").collect()
    telling = [r.unit for k, r in enumerate(telling) if r.ratio >= TELLING or k < 8]
    common = [r.unit for r in counts.where(F.col("ratio") < 8).orderBy(F.desc("n"), "unit").limit(max_landmarks // 2).select("unit").collect()]
    landmarks = list(dict.fromkeys(telling + common))
    if not landmarks:
        return share
    numbers, vectors = _landmark_vectors(landmarks)
    value, basis = np.linalg.eigh(_against(landmarks, numbers, vectors))
    good = np.flatnonzero(value > 1e-6 * value.max())[-max_features:]
    whiten = basis[:, good] / np.sqrt(value[good])
    nearest, features_of = vectors[:, : len(telling)].max(1), vectors @ whiten
    del vectors
    told = sample.mapInArrow(_suspects(numbers, nearest, features_of, max_suspects), "toxic int, rows binary").collect()
    rows = [np.frombuffer(r.rows, np.float32).reshape(-1, len(good)) for r in told]
    toxic = np.array([r.toxic for r in told])
    del told
    if len(set(toxic.tolist())) < 2:
        return share
    w, bias = fit_sentences(rows, toxic)
    machine = Machine(numbers, (features_of @ w).astype(np.float32), bias, np.zeros(4))
    seen = sample.mapInArrow(_scoring(machine, ("toxic",)), f"{TOLD}, toxic int")
    seen = np.array([tuple(r) for r in seen.select("best", "amount", "extent", "toxic").collect()], float)
    machine.curve = fit_logistic(seen[:, :3], seen[:, 3])
    forget(sample)
    return machine


def _landmark_vectors(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(subsequence numbers, sorted; one column of weights for each landmark)."""
    parts = [features(coded(u)[None, :]) for u in landmarks]
    numbers = np.unique(np.concatenate([n[0] for n, _ in parts]))
    vectors = np.zeros((len(numbers), len(landmarks)))
    for k, (n, w) in enumerate(parts):
        np.add.at(vectors[:, k], np.searchsorted(numbers, n[0]), w)
    return numbers, vectors


def _against(units: list[str], numbers: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(units), vectors.shape[1]))
    for i, u in enumerate(units):
        n, w = features(coded(u)[None, :])
        at = np.minimum(np.searchsorted(numbers, n[0]), len(numbers) - 1)
        hit = numbers[at] == n[0]
        out[i] = w[hit] @ vectors[at[hit]]
    return out


TOLD = "doc_id long, best double, amount double, extent double"


def _scoring(machine: Machine, more: tuple[str, ...] = ()):
    tables: list[np.ndarray] = []

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        if not tables:
            tables.append(machine.table())
        told = suspicion(Words(part.column(1)), tables[0], machine.bias)
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(told[:, k]) for k in range(3)), *(part.column(2 + k) for k in range(len(more)))], names=["doc_id", "best", "amount", "extent", *more])

    return per_slice(run)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher is likelier toxic), predicted.

    Rows whose crc32(id) mod 5 is 0 are held out of training. Texts without words, null
    ones included, are scored as texts without any sentence. If the labels hold one class only, or none, every
    score is the smoothed share of toxic rows, (toxic + 0.5) / (rows + 2). Several labels of one row count as the
    highest; labels that are null or have no id are none. Repeated rows and ties get equal scores; rows without an id are scored, and
    never trained on; whether they are held out is null. Texts of any length are read whole. Other columns, whatever their
    names, are not read. An empty table gives an empty result.
    """
    read = text_column(docs, id_col, text_col)
    machine = train(read, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), **limits)
    if isinstance(machine, float):
        scored = read.select("doc_id", F.lit(machine).alias("score"))
    else:
        *slopes, start = map(float, machine.curve)
        margin = sum((F.col(c) * by for c, by in zip(("best", "amount", "extent"), slopes, strict=True)), F.lit(start))
        scored = read.mapInArrow(_scoring(machine), TOLD).select("doc_id", (1 / (1 + F.exp(-margin))).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
