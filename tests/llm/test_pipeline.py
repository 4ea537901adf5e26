"""The pipeline's stages against the definitions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline as pipeline
from conftest import SF_DIR, TEXTS
from quillspark.llm.quality import quality_rules
from quillspark.llm.queries import QUERIES, byte_level, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts_of(df):
    assert df.columns == COLUMNS
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, docs, texts):
    kept = pipeline.quality(spark, docs, SF_DIR)
    verdict = {r.doc_id: r.kept for r in quality_rules(docs, vocabulary("piece_bpe_32k.model"), multi=byte_level()).collect()}
    own = {d: t for d, t in texts.items() if verdict[d]}
    assert texts_of(kept) == own
    few = docs.where("doc_id < 60")
    assert texts_of(pipeline.lines(spark, few, SF_DIR)) == brute.lines({d: t for d, t in texts.items() if d < 60})
    groups = brute.jaccard(texts)
    assert texts_of(pipeline.near_duplicates(spark, docs, SF_DIR)) == {d: t for d, t in texts.items() if groups[d][1] == d}
    clean = texts_of(pipeline.secrets(spark, docs, SF_DIR))
    assert set(clean) == set(texts) and not any(brute.secrets(t)[4] for t in clean.values())
    assert all(clean[d] == t or re.sub(r"\[SECRET\]", "", clean[d]) != t for d, t in texts.items())
    rows = pipeline.packing(spark, few, SF_DIR).collect()
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == brute.pieces({d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in texts.items() if d < 60}, 2048)


def test_stages_take_odd_and_empty_tables(spark, odd):
    for table in (odd, odd.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, table, SF_DIR)
            assert name == "best-fit packing" or out.columns == COLUMNS
            rows = out.collect()
            assert len(rows) <= max(1, 10 * len(TEXTS)) * (table is odd)
            assert table is not odd or any(r.doc_id is None for r in rows)


def test_queries_apply_their_operators(spark, texts):
    """The registered queries themselves, against the definitions."""
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op7_jaccard_join"](spark, SF_DIR).collect()}
    assert got == brute.jaccard(texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op10_substring_dedup"](spark, SF_DIR).collect()}
    assert got == brute.substrings(texts)
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in QUERIES["op5_secret_scan"](spark, SF_DIR).collect()}
    assert got == {d: brute.secrets(t)[:4] for d, t in texts.items()}


def test_run(spark):
    out = pipeline.run(spark, SF_DIR)
    assert out.agg(F.sum("length")).first()[0] > 0


def test_registered_operators():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]
