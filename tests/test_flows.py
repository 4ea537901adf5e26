"""Experts built end to end from small tables."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from quillspark.operators import registry
from quillspark.plans import flows
from quillspark.providers import Providers
from quillspark.sources.store import Store

MAP = "map<string,string>"
SOURCES = f"slug string, rank int, url string, title string, content string, source_type string, metadata {MAP}"


def inputs(spark):
    rows = [("deep-sea", k, f"u{k}", f"t{k}", f"fish {k} swim deep " * 30 if k != 2 else " ", "web", {"score": "1"}) for k in range(1, 4)]
    sources = spark.createDataFrame(rows, SOURCES)
    crawls = spark.createDataFrame([("u1", "crawled", "whales dive " * 40)], "url string, title string, content string")
    papers = spark.createDataFrame([("deep-sea", 1, "p1", "paper", "on squids", "arxiv", {})], SOURCES)
    return spark.createDataFrame([("Deep Sea",), ("!!",)], "topic string"), sources, crawls, papers


def test_build(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    got = flows.build_experts(store, *inputs(spark)).collect()
    assert [(r.slug, r.status, r.source_count) for r in got] == [("deep-sea", "ready", 4)]
    assert got[0].node_count > 0 and got[0].relation_count > 0 and "crawled" in got[0].description
    assert store.read("chunks").select("doc_id").distinct().count() == 3
    before = store.read("vectors").count()
    assert before == store.read("chunks").count()
    # Ready experts are left alone.
    flows.build_experts(store, *inputs(spark), version=2)
    assert store.read("vectors").count() == before


def test_failure_marks_experts(spark, tmp_path):
    store = Store(spark, str(tmp_path))

    def broken(text):
        raise RuntimeError("no service")

    with pytest.raises(RuntimeError, match="no service"):
        flows.build_experts(store, *inputs(spark), providers=Providers(embed=broken))
    assert store.read("expert_versions").orderBy("version").select("status").collect()[-1].status == "failed"
    assert [r.payload for r in store.read("progress").collect()] == ["ERROR: no service"]


def test_turn(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    flows.build_experts(store, *inputs(spark))
    assert store.read("progress").count() == 5
    asked = spark.createDataFrame([("deep-sea", "do whales dive"), ("nobody", "hello")], "slug string, text string")
    got = {r.slug: (r.code, r.answer) for r in flows.converse(store, asked).collect()}
    assert got["nobody"] == (404, None) and got["deep-sea"][0] == 200 and "whales dive" in got["deep-sea"][1]
    blank = flows.converse(store, spark.createDataFrame([("deep-sea", " ")], "slug string, text string")).collect()
    assert [(r.code, r.answer) for r in blank] == [(400, None)]
    # A reply that gives nothing leaves the question alone; the next turn sees both.
    none = flows.converse(store, asked, Providers(answer=lambda context, question: F.lit(None).cast("string"))).where("slug = 'deep-sea'").collect()
    assert none[0].answer is None
    seen = flows.converse(store, asked, Providers(answer=lambda context, question: F.concat(F.lit("re: "), question))).where("slug = 'deep-sea'").collect()
    assert seen[0].answer == "re: do whales dive"
    rows = store.read("messages").orderBy("seq").collect()
    assert [(r.seq, r.role) for r in rows] == [(1, "user"), (2, "assistant"), (3, "user"), (4, "user"), (5, "assistant")]


def test_course(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    flows.build_experts(store, *inputs(spark))
    asked = spark.createDataFrame([("deep-sea", "beginner", ""), ("nobody", "beginner", None)], "slug string, difficulty string, focus string")
    got = {r.slug: (r.code, r.text) for r in flows.write_courses(store, asked).collect()}
    assert got["nobody"] == (404, None)
    assert got["deep-sea"][0] == 200 and got["deep-sea"][1].startswith("# Deep Sea") and got["deep-sea"][1].endswith("That was it.")
    assert store.read("course_text").count() > 4


def test_settings_limit_a_build(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    spark.conf.set("quillspark.max_paths_per_chunk", "2")
    try:
        flows.build_experts(store, *inputs(spark))
    finally:
        spark.conf.unset("quillspark.max_paths_per_chunk")
    most = store.read("relations").where("rel = 'NEXT_TO'").groupBy("doc_id", "chunk_id").count().agg(F.max("count")).first()[0]
    assert most == 2


def test_an_entry_without_status_is_missing(spark):
    rows = spark.createDataFrame([("a", None), ("b", "ready")], "slug string, status string")
    assert [r.slug for r in registry.present(rows).collect()] == ["b"]
