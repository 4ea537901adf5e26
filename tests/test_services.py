"""Service formats against a local stub."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillspark.plans import research
from quillspark.settings import Settings
from quillspark.sources import services
from quillspark.sources.store import Store
from services_stub import service


def answers(path, query):
    q, n = query["q"], int(query["limit"])
    if "broken" in q:
        return 500
    if "gone" in q:
        return 404
    if path == "/web":
        return [{"url": f"u/{q}/{k}", "title": None if k == 2 else f"t{k}", "text": "short" if k == 3 else f"{q} text {k} " * 20, "metadata": {"score": k / 2}} for k in range(1, 8)]
    if path == "/crawl":
        return [] if q.endswith("/1") else [{"content": f"page of {q} " * 30, "metadata": {"title": f"page {q}"}}]
    if path == "/papers":
        return [{"url": f"p{k}", "title": f"paper {k}", "authors": ["A", "B"], "abstract": "abstract", "published": "2020"} for k in range(9)][:n]
    return [{"start": k * 1.0, "text": f"segment {k} of {q}"} for k in range(30)]


def read(spark, kind, at, requests, **options):
    services.register(spark)
    return spark.read.format(f"quill_{kind}").options(requests=json.dumps(requests), wait="0.01", **options).option("endpoint", f"{at}/{kind}").load()


def test_a_request_is_a_partition_and_filters_go_down(spark):
    with service(answers) as (at, asked):
        df = read(spark, "web", at, ["a", "b", "c", "a"])
        assert df.rdd.getNumPartitions() == 3
        got = df.where("request = 'b' and rank <= 2").collect()
        assert [(r.request, r.rank, r.url, r.metadata) for r in got] == [("b", 1, "u/b/1", {"score": "0.5"}), ("b", 2, "u/b/2", {"score": "1.0"})]
        assert {q["q"]: q["limit"] for _, q in asked} == {"b": "2"}
        assert df.where("rank < 3 and request in ('a', 'c')").count() == 4
        assert read(spark, "web", at, []).count() == 0
        assert read(spark, "web", at, ["x", "y", "z"], per_partition="2", suffix=" overview", limit="1").where(F.col("url").contains("overview")).count() == 3


def test_failures_end_the_job_or_give_nothing(spark):
    with service(answers) as (at, asked):
        with pytest.raises(Exception, match="web source, broken"):
            read(spark, "web", at, ["a", "broken"], retries="0").collect()
        del asked[:]
        assert {r.request for r in read(spark, "crawl", at, ["x/2", "broken", "gone"]).collect()} == {"x/2"}
        # What may pass is asked for again, what won't isn't.
        assert sorted(q["q"] for _, q in asked) == ["broken"] * 3 + ["gone", "x/2"]
        told = read(spark, "crawl", at, ["x/2", "gone"], on_error="report").where("error is not null").collect()
        assert [r.request for r in told] == ["gone"] and "404" in told[0].error
        with pytest.raises(Exception, match="on_error"):
            read(spark, "crawl", at, ["x"], on_error="ignore").collect()


def test_a_function_may_stand_for_a_service(spark):
    services.register(spark)
    asking = services.Asking.of("papers", {"client": "test_services:three", "limit": "2"})
    assert list(services.hits("a", asking)) == [("a", k, None, f"a {k - 1}", None, None, None, None, None) for k in (1, 2)]
    with pytest.raises(Exception, match="either an endpoint or a client"):
        spark.read.format("quill_papers").load().collect()
    with pytest.raises(Exception, match="no_such_module"):
        spark.read.format("quill_papers").option("requests", '["a"]').option("client", "no_such_module:f").load().collect()


def three(query, limit, asking):
    return [{"title": f"{query} {k}"} for k in range(3)]


def test_fetch_equals_the_format(spark):
    with service(answers) as (at, _):
        names = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "topic string")
        for kind in ("web", "papers", "transcripts"):
            got = services.fetch(names, kind, "topic", endpoint=f"{at}/{kind}").collect()
            assert sorted(map(str, got)) == sorted(map(str, read(spark, kind, at, ["a", "b"]).collect()))


def test_research(spark):
    said = Settings(crawls=3)
    topics = spark.createDataFrame([("a", "a"), ("b", "b")], "slug string, topic string")
    with service(answers) as (at, _):
        found = research.searched(topics, {"endpoint": f"{at}/web"}, said)
        rows = found.where("slug = 'a'").orderBy("rank").collect()
        assert [(r.rank, r.url, r.title, r.source_type) for r in rows] == [(k, f"u/a/{h}", "u/a/2" if h == 2 else f"t{h}", "web") for k, h in enumerate((1, 2, 4, 5, 6, 7), 1)]
        pages = research.crawled(found, {"endpoint": f"{at}/crawl"}, said)
        assert sorted(r.url for r in pages.collect()) == ["u/a/2", "u/a/4", "u/b/2", "u/b/4"]
        own = research.papers(topics, {"endpoint": f"{at}/papers"}, said).where("slug = 'b'").orderBy("rank").collect()
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and own[0].content == "## paper 0\n\nBy: A, B\n\nabstract\n\nDate: 2020" and own[0].metadata == {"authors": "A, B", "published": "2020"}
        videos = spark.createDataFrame([("https://v.example/watch?v=abcdefghijk", ""), ("none", "x")], "url string, title string")
        told = research.transcripts(videos, {"endpoint": f"{at}/transcripts"}).collect()
        assert [(r.video_id, r.title) for r in told] == [("abcdefghijk", "YouTube: abcdefghijk")] and told[0].content.startswith("segment 0 of abcdefghijk segment 1")


def test_a_build_goes_on_without_pages_and_papers(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    topics = spark.createDataFrame([("Deep Sea",)], "topic string")

    def half(path, query):
        return 404 if path != "/web" else answers(path, query)

    with service(half) as (at, asked):
        got = research.research_and_build(store, topics, {k: {"endpoint": f"{at}/{k}"} for k in ("web", "crawl", "papers")}).collect()
        assert [(r.slug, r.status, r.source_count) for r in got] == [("deep-sea", "ready", 6)]
        del asked[:]
        research.research_and_build(store, topics, {"web": {"endpoint": f"{at}/web"}})
        assert asked == []
    assert store.listed(f"{store.folder}/scratch") == []
    with service(lambda *_: 404) as (at, _), pytest.raises(Exception, match="web source, High Hills"):
        research.research_and_build(store, spark.createDataFrame([("High Hills",)], "topic string"), {"web": {"endpoint": f"{at}/web"}})
    rows = store.read("expert_versions").where("slug = 'high-hills'").orderBy("version").collect()
    assert [r.status for r in rows] == ["building", "failed"]
    assert any(r.payload.startswith("ERROR: ") and "web source" in r.payload for r in store.read("progress").where("slug = 'high-hills'").collect())
