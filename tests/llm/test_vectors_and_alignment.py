"""Nearest neighbours, clustering and alignment against the definitions in brute.py."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from conftest import SF_DIR, TEXTS, clashing
from quillspark.llm import alignment, clustering, nearest, queries

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<double>, label int"


def vectors_of(df):
    return {r.vec_id: r.embedding for r in df.collect() if r.vec_id is not None and brute.usable(r.embedding)}


def recall_of(got, vectors, asked, k):
    """The share of true neighbours found, after holding each row to its cosine, rank and order."""
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    hits = total = 0
    for q in asked:
        want, own = brute.nearest(vectors, q, k), found.get(q, [])
        assert len(own) == len(want) and [x[2] for x in own] == list(range(1, len(own) + 1))
        assert len({x[0] for x in own} | {q}) == len(own) + 1
        exact = dict(brute.nearest(vectors, q, len(vectors)))
        assert all(abs(exact[i] - s) < 1e-9 for i, s, _ in own)
        assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(own, own[1:], strict=False))
        # A neighbour as near as the last true one counts: it may stand for it.
        hits += sum(s >= want[-1][1] - 1e-12 for _, s, _ in own)
        total += len(want)
    return hits / max(1, total)


# 11


def test_nearest_reaches_the_recall(spark):
    got = queries.QUERIES["op11_nearest_neighbours"](spark, SF_DIR)
    assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"] and dict(got.dtypes)["rank"] == "int"
    vectors = vectors_of(spark.read.parquet(f"{SF_DIR}/embeddings.parquet"))
    assert recall_of(got.collect(), vectors, [i for i in vectors if i % 50 == 0], 5) >= 0.9


def clustered(n, seed=3, width=16):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((20, width))[rng.integers(0, 20, n)] + 0.4 * rng.standard_normal((n, width))
    rows[: n // 3] = rows[0]  # a third of all are copies
    return rows


def test_nearest_visits_a_part_of_the_lists(spark):
    rows = clustered(3000)
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(rows)], VECTORS)
    asked = [i for i in range(3000) if i % 150 == 0]
    got = nearest.approximate_nearest(df, df.where("vec_id % 150 = 0"), block=256).collect()
    vectors = {i: r.tolist() for i, r in enumerate(rows)}
    assert recall_of(got, vectors, asked, 5) >= 0.9
    # Copies tie: the lowest other ids win.
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [1, 2, 3, 4, 5]
    units = rows / np.sqrt((rows * rows).sum(1, keepdims=True))
    index = nearest.fitted(units[::3], 3000)
    counts = np.bincount(index.cells(units), minlength=len(index.halves[0]) * len(index.halves[1]))
    index = nearest.Index(index.halves, counts)
    entries = df.select("vec_id", "embedding").mapInArrow(nearest._celled(index), "vec_id long, embedding array<double>, cell long")
    depth = nearest.depth_for(index, entries, df.where("vec_id % 40 = 7").collect(), 5, 0.96)
    assert depth < np.count_nonzero(counts) / 2


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(0)
    index = nearest.Index((np.zeros((6, 1)), np.zeros((7, 1))), np.r_[np.zeros(5, int), np.ones(37, int)])
    for _ in range(20):
        first, second = rng.random(6), rng.random(7)
        first[2] = first[3]
        cells = list(index.visited(first, second))
        sums = [first[c // 7] + second[c % 7] for c in cells]
        assert sums == sorted(sums) and sorted(cells) == list(range(5, 42))


def test_blocks_are_bounded():
    rng = random.Random(5)
    for _ in range(50):
        counts = np.array([rng.choice((0, 1, 5, 30, 100, 1000)) for _ in range(40)])
        first, parts = nearest.dealt(counts, 100)
        held = {}
        for c, (a, n) in enumerate(zip(first.tolist(), parts.tolist(), strict=True)):
            for b in range(a, a + n):
                held.setdefault(b, []).append(counts[c] / n)
        assert all(sum(x) < 200 for x in held.values()) and all(len(x) == 1 or max(x) <= 100 for x in held.values())
        assert all(n == max(1, -(-c // 100)) for c, n in zip(counts, parts, strict=True))


def test_nearest_takes_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 2.0], 1), (3, [1e-200, 1e-200], 0), (4, [1e200, -1e200], 0), (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0), (8, [None, 1.0], 0), (9, [float("nan"), 1.0], 0),
            (10, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0), (11, [1.0, 2.0, 3.0], 0), (12, [5.0], 0), (13, [1.0, 2.0, 3.0], None), (14, [-1.0], 1)]
    df = clashing(spark.createDataFrame(rows, VECTORS)).withColumns({c: F.lit("x") for c in ("cell", "block", "score", "query_id", "rank")})
    got = {}
    for r in nearest.approximate_nearest(df, df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    half = round(0.5**0.5, 9)
    # Of id 1 the least vector by components stands.
    assert got == {1: [(2, 1.0), (3, half), (4, -half)], 2: [(1, 1.0), (3, half), (4, -half)], 3: [(1, half), (2, half), (4, 0.0)], 4: [(3, 0.0), (1, -half), (2, -half)], 11: [(13, 1.0)], 13: [(11, 1.0)], 12: [(14, -1.0)], 14: [(12, -1.0)]}
    assert nearest.approximate_nearest(df.limit(0), df).count() == nearest.approximate_nearest(df, df.limit(0)).count() == 0


# 12


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def test_clusters(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").where("vec_id < 200")
    assert rows_of(clustering.centroid_clustering(table)) == brute.clusters([(r.vec_id, r.embedding) for r in table.collect()])


def test_tables_give_distances():
    rng = np.random.default_rng(1)
    rows, centroids = rng.integers(-300, 300, (500, 7)), rng.integers(-300, 300, (9, 7))
    assert (clustering.squared_distances(rows, centroids) == ((rows[:, None] - centroids[None]) ** 2).sum(2)).all()


def test_clusters_take_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice((-1.0, -0.25, 0.0, 0.4999)) for _ in range(3)], 0) for i in range(60)]
    rows += [(3, [0.1, 0.2, 0.3], 0), (3, [0.1, 0.2, 0.3], 0), (None, [0.5, 0.5, 0.5], 0), (100, None, 0), (101, [1.0, 2.0], 0), (102, [None, 1.0, 1.0], 0), (103, [float("nan"), 1.0, 1.0], 0), (104, [float("-inf"), 1.0, 1.0], 0), (105, [2000.0, -3000.0, 1.0], 0)]
    df = clashing(spark.createDataFrame(rows, VECTORS)).withColumns({c: F.lit("x") for c in ("cluster", "distance", "v", "inertia")})
    for k in (1, 5, 40, 500):
        assert rows_of(clustering.centroid_clustering(df, clusters=k, width=3)) == brute.clusters([r[:2] for r in rows], width=3, clusters=k)
    # What a long might not hold is left out.
    huge = spark.createDataFrame([(1, [1e300, 0.0, 0.0], 0), (2, [1.0, 0.0, 0.0], 0)], VECTORS)
    assert [r[0] for r in rows_of(clustering.centroid_clustering(huge, width=3))] == [2]
    assert rows_of(clustering.centroid_clustering(df.limit(0), width=3)) == []


# 13


def definitions(texts):
    first, second = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    alphabet, names = alignment.byte_alphabet(), {i: t for t, i in first.get_vocab().items()}
    spelt = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    return brute.alignments(texts, lambda t: first.encode(t, add_special_tokens=False).ids, second.encode, lambda i: bytes(alphabet[c] for c in names[i]), spelt)


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "a\n\n  b c", "<|endoftext|> x <s>", "▁", "a▁b c", "é̀ nbsp x", "\x1c a\x1cb \x1c", "　 　x", "x" * 300, "日本 語😀 don't we'll  IT'S", "\t tab", "a" + " " * 20 + "b", "\x00 nul \x00"]


def compared(spark, texts, **limits):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.cross_tokenizer_alignment(df, BYTES, PIECES).documents.collect()}
    assert got == definitions(texts)


def test_alignment(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op13_tokenizer_alignment"](spark, SF_DIR).collect()}
    ids = [r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()]
    wanted = definitions(texts)
    assert {i: got[ids[i]] for i in range(len(ids))} == wanted


@pytest.mark.parametrize("large", [4096, 1])
def test_alignment_of_odd_texts(spark, monkeypatch, large):
    monkeypatch.setattr(alignment, "LARGE_GROUP", large)
    rng = random.Random(4)
    texts = ODD + TEXTS + ["".join(rng.choice(" abc\n\t▁é日.,'s ") for _ in range(30)) for _ in range(200)]
    compared(spark, texts)


def test_runs_come_back():
    rng = np.random.default_rng(2)
    key = rng.integers(0, 50, 5000) << 32 | rng.integers(0, 40, 5000)
    row = np.sort(rng.integers(0, 900, 5000))
    links = np.where(rng.random(5000) < 0.01, 70_000, rng.integers(1, 9, 5000))
    held, runs = {}, list(alignment._spilt(7, key, row, links))
    for r in runs:
        pairs, sizes = alignment.pairs_of_run(r["pairs"])
        assert (np.diff(pairs) > 0).all()
        rows, n = alignment.links_of_run(r["links"], r["n"], 7, sizes)
        for x in zip(np.repeat(pairs, sizes).tolist(), rows.tolist(), n.tolist(), strict=True):
            held[x] = held.get(x, 0) + 1
    want = {}
    for x in zip(key.tolist(), (row + 7).tolist(), links.tolist(), strict=True):
        want[x] = want.get(x, 0) + 1
    assert held == want
    halves = [list(alignment._spilt(0, key[a:b], row[a:b], links[a:b])) for a, b in ((0, 2000), (2000, 5000))]
    for c in range(alignment.CLASSES):
        own = [r["pairs"] for half in halves for r in half if r["class"] == c]
        if own:
            found, n = alignment.merged(own)
            some = key[alignment.class_of(key) == c]
            assert (np.diff(found) > 0).all() and dict(zip(found.tolist(), n.tolist(), strict=True)) == dict(zip(*(x.tolist() for x in np.unique(some, return_counts=True)), strict=True))


def test_alignment_in_many_runs_and_parts(spark, monkeypatch):
    """Small runs, of classes dealt to several parts, among them a pair that all documents hold."""
    monkeypatch.setattr(alignment, "RUN_RECORDS", 20)
    monkeypatch.setattr(alignment, "MERGED_RECORDS", 50)
    monkeypatch.setattr(alignment, "TOGETHER", 7)
    rng = random.Random(6)
    compared(spark, ["the " + " ".join(rng.choice(("river", "of", "Straße", "don't", "x-1", "the")) for _ in range(12)) for _ in range(120)])


def test_alignment_takes_odd_tables(spark, odd):
    out = alignment.cross_tokenizer_alignment(odd, BYTES, PIECES)
    rows = out.documents.collect()
    assert len(rows) == len(TEXTS) + 2 and any(r.doc_id is None for r in rows)
    assert len({tuple(r) for r in rows if r.doc_id == 3}) == 1
    pairs = {(r.a_id, r.b_id): r.n_docs for r in out.pairs.collect()}
    assert out.pairs.where("is_best").select("a_id").distinct().count() == len({a for a, _ in pairs})
    empty = alignment.cross_tokenizer_alignment(odd.limit(0), BYTES, PIECES)
    assert empty.documents.count() == empty.pairs.count() == 0


@pytest.mark.parametrize("table", ["alignment", "nearest", "clustering"])
def test_no_local_checkpoint(table):
    import importlib
    import inspect

    assert "localCheckpoint" not in inspect.getsource(importlib.import_module(f"quillspark.llm.{table}"))
