"""Sentence-aware chunks, batched embedding, named providers."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark import providers
from quillspark.operators.sentences import chunked, sentence_chunks, sentences, vocabulary_counted, words_counted
from quillspark.plans import flows
from quillspark.sources.store import Store
from test_flows import inputs

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def some_text(rng, n):
    return " ".join(" ".join(rng.choice(("whales", "dive", "deep", "extraordinarily", "a")) for _ in range(rng.randint(1, 14))) + rng.choice((". ", "!\n", "?” ", ".\n\n")) for _ in range(n))


def test_sentences():
    assert sentences("One two. “Three?” Four… five!\n\nSix") == ["One two. ", "“Three?” ", "Four… ", "five!\n\n", "Six"]
    assert sentences("") == sentences(" \n\n ") == [] and sentences(" a. \n") == [" a. \n"]
    assert sentences("3.14 is pi。次。") == ["3.14 is pi。", "次。"]
    rng = random.Random(1)
    for _ in range(50):
        text = some_text(rng, 12)
        assert "".join(sentences(text)) == text and all(s.strip() for s in sentences(text))


@pytest.mark.parametrize("count", [words_counted, vocabulary_counted(VOCABULARY)])
def test_chunks_hold_whole_sentences(count):
    rng = random.Random(2)
    for size, overlap in ((30, 10), (12, 0), (20, 19), (5, 2)):
        for _ in range(20):
            text = some_text(rng, 15)
            got, own = chunked(text, size, overlap, count), [(s.strip(), n) for s, n in zip(sentences(text), count(sentences(text)), strict=True)]
            assert all(n <= size for _, n in got)
            # Every sentence that fits is whole in some chunk; all words are there, in order.
            assert all(any(s in c for c, _ in got) for s, n in own if n <= size)
            assert set(text.split()) == {w for c, _ in got for w in c.split()}
            if all(n <= size for _, n in own):
                # Spelt out: greedy, the next chunk from as far back as the overlap reaches.
                want, start, at = [], 0, 0
                while at < len(own):
                    while at < len(own) and sum(n for _, n in own[start : at + 1]) <= size:
                        at += 1
                    want.append(sum(n for _, n in own[start:at]))
                    start = at
                    while at < len(own) and start and sum(n for _, n in own[start - 1 : at]) <= overlap and sum(n for _, n in own[start - 1 : at + 1]) <= size:
                        start -= 1
                assert [n for _, n in got] == want


def test_what_does_not_fit_is_cut():
    got = chunked("x" * 100 + " " + "word " * 50 + "end. Short one.", 8, 3, words_counted)
    assert [n for _, n in got][:3] == [8, 8, 8] and got[-1][0].endswith("Short one.")
    assert "".join(c for c, _ in chunked("日" * 90, 5, 0, lambda ts: [len(t) for t in ts])) == "日" * 90


def test_sentence_chunks(spark):
    rng = random.Random(3)
    texts = [some_text(rng, 40), " ", None, "one", some_text(rng, 3)]
    docs = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "slug string, doc_id long, text string")
    for vocabulary, count in ((None, words_counted), (VOCABULARY, vocabulary_counted(VOCABULARY))):
        out = sentence_chunks(docs, 40, 10, vocabulary=vocabulary)
        got = sorted((r.doc_id, r.chunk_id, r.text, r.n_tokens) for r in out.collect())
        assert got == [(i, k, c, n) for i, t in enumerate(texts) if t and t.strip() for k, (c, n) in enumerate(chunked(t, 40, 10, count))]
        assert out.columns == ["slug", "doc_id", "chunk_id", "n_chunks", "n_tokens", "text"]
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sentence_chunks(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        sentence_chunks(docs, 10, 10)


def test_batched_embedding(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", None, "ccc", " ", "dddd", "a", "eeeee"])], "i int, t string").coalesce(1)
    embed = providers.batched_embedding(lambda texts: [[float(len(t)), float(len(texts))] for t in texts], 2, batch=3)
    got = {r.i: r.v for r in rows.select("i", embed(F.col("t")).alias("v")).collect()}
    # Batches of three in order, equal texts once: a bb ccc, then dddd eeeee.
    assert got == {0: [1, 3], 1: [2, 3], 2: None, 3: [3, 3], 4: None, 5: [4, 2], 6: [1, 3], 7: [5, 2]}
    with pytest.raises(Exception, match="WidthError"):
        rows.select(providers.batched_embedding(lambda ts: [[1.0]] * len(ts), 2)(F.col("t"))).collect()
    failed = []

    def flaky(texts):
        if len(failed) < 2:
            failed.append(1)
            raise OSError("busy")
        return [[0.0, 1.0]] * len(texts)

    assert rows.select(F.count_if(providers.batched_embedding(flaky, 2, wait=0.01)(F.col("t")).isNotNull())).first()[0] == 6
    with pytest.raises(Exception, match="busy"):
        rows.select(providers.batched_embedding(flaky, 2, retries=1, wait=0.01)(F.col("t"))).collect()


def test_providers_by_name(spark):
    assert providers.breaches(spark, providers.chosen(spark)) == []
    embed = providers.batched_embedding(lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    providers.register("own", lambda: providers.Providers(embed=embed))
    spark.conf.set("quillspark.provider", "own")
    try:
        assert providers.breaches(spark, providers.chosen(spark), width=2) == []
        bad = providers.Providers(embed=lambda t: F.array(F.rand().cast("float")), paths=lambda t, n: F.array_repeat(F.struct(t, t, t), 5), deltas=lambda t: F.split(t, " "))
        assert len(providers.breaches(spark, bad)) >= 4
        spark.conf.set("quillspark.provider", "none")
        with pytest.raises(KeyError, match="offline, own"):
            providers.chosen(spark)
    finally:
        spark.conf.unset("quillspark.provider")


def test_a_build_in_sentences(spark, tmp_path):
    settings = {"quillspark.chunks": "sentences", "quillspark.chunk_tokens": "20", "quillspark.chunk_overlap": "5"}
    store = Store(spark, str(tmp_path))
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        flows.build_experts(store, *inputs(spark))
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert store.read("chunks").agg(F.max("n_tokens")).first()[0] <= 20 and store.read("vectors").count() == store.read("chunks").count() > 10
