"""Builds as transactions: failures at each stage, rebuilds, several topics, writers that race."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph
from quillspark.plans import flows
from quillspark.providers import Providers
from quillspark.sources import builds
from quillspark.sources.builds import Build, Conflict, Log
from quillspark.sources.store import Store
from test_flows import SOURCES, inputs

TABLES = ["sources", "chunks", "relations", "nodes", "vectors"]


def held(store, tables=TABLES):
    return {t: sorted(map(str, store.read(t).collect())) for t in tables}


def latest(rows):
    return {r.slug: (r.status, r.source_count, r.node_count, r.relation_count, r.description) for r in rows.collect()}


def failing_at(stage, monkeypatch):
    whole = Build.stage

    def stage_or_fail(self, name, rows):
        if name == stage:
            raise RuntimeError(f"no {name}")
        return whole(self, name, rows)

    monkeypatch.setattr(Build, "stage", stage_or_fail)


@pytest.fixture(scope="module")
def clean(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("clean")))
    return latest(flows.build_experts(store, *inputs(spark))), held(store)


@pytest.mark.parametrize(("stage", "resumed"), [("targets", True), ("sources", False), ("relations", True), ("vectors", False), ("expert_versions", True), ("progress", False)])
def test_a_build_that_failed_leaves_nothing(spark, tmp_path, monkeypatch, clean, stage, resumed):
    store = Store(spark, str(tmp_path))
    with monkeypatch.context() as m:
        failing_at(stage, m)
        with pytest.raises(RuntimeError, match=f"no {stage}"):
            flows.build_experts(store, *inputs(spark))
    assert all(not rows for rows in held(store).values())
    assert [r.status for r in store.read("expert_versions").orderBy("version").collect()] == ["building", "failed"]
    got = flows.build_experts(store, *inputs(spark), resume=Log(store).begun()[-1] if resumed else None)
    assert (latest(got), held(store)) == clean
    versions = [(r.version, r.status) for r in store.read("expert_versions").orderBy("version").collect()]
    assert [s for _, s in versions] == ["building", "failed", "building", "ready"] and len({v for v, _ in versions}) == 4
    assert builds.vacuum(store) == [1] and held(store) == clean[1]


def test_finished_tables_are_taken_over(spark, tmp_path):
    store, asked = Store(spark, str(tmp_path)), []

    def paths(text, most):
        asked.append(1)
        return graph.neighbour_paths(text, most)

    def broken(text):
        raise RuntimeError("no service")

    with pytest.raises(RuntimeError):
        flows.build_experts(store, *inputs(spark), providers=Providers(paths=paths, embed=broken))
    assert Build(store, 1).staged("nodes") and len(asked) == 1
    flows.build_experts(store, *inputs(spark), providers=Providers(paths=paths), resume=1)
    assert len(asked) == 1 and not Build(store, 1).staged("nodes")
    # A build of other experts takes nothing over.
    other = spark.createDataFrame([("High Hills",)], "topic string")
    flows.build_experts(store, other, *inputs(spark)[1:], resume=1)
    assert latest(store.read("expert_versions"))["high-hills"][:2] == ("ready", 0)
    with pytest.raises(Conflict):
        Build(store, 9).adopt(2)


def two(spark):
    topics, sources, crawls, papers = inputs(spark)
    more = spark.createDataFrame([("high-hills", k, f"h{k}", f"hill {k}", f"stones on hill {k} " * 20, "web", {}) for k in (1, 2)], SOURCES)
    return spark.createDataFrame([("High Hills",)], "topic string"), sources.union(more), crawls, papers


def test_topics_leave_each_other_alone(spark, tmp_path, clean):
    store = Store(spark, str(tmp_path))
    flows.build_experts(store, *inputs(spark))
    flows.build_experts(store, *two(spark))
    got = latest(store.read("expert_versions").where("status = 'ready'"))
    assert got["deep-sea"] == clean[0]["deep-sea"] and got["high-hills"][:2] == ("ready", 2)
    own = {t: sorted(map(str, store.read(t).where("slug = 'deep-sea'").collect())) for t in TABLES if t != "vectors"}
    own["vectors"] = sorted(map(str, store.read("vectors").where("namespace = 'expert-deep-sea'").collect()))
    assert own == clean[1]
    assert store.read("expert_versions").count() == 4


@pytest.mark.parametrize("mode", ["append", "replace"])
def test_rebuilt_vectors_add_or_replace(spark, tmp_path, clean, mode):
    """An expert that failed after it was ready is built again: its vectors add up or not, its other tables never."""
    store = Store(spark, str(tmp_path))
    flows.build_experts(store, *inputs(spark))
    store.append("expert_versions", store.read("expert_versions").where("status = 'ready'").withColumn("status", F.lit("failed")).withColumn("version", F.lit(7).cast("long")))
    got = flows.build_experts(store, *inputs(spark), version=10, mode=mode)
    assert latest(got) == clean[0]
    own = held(store)
    assert own.pop("vectors") == sorted(clean[1]["vectors"] * (2 if mode == "append" else 1))
    assert own == {t: rows for t, rows in clean[1].items() if t != "vectors"}
    # What the last build replaced may go.
    assert builds.vacuum(store) == ([1] if mode == "replace" else [])
    assert held(store)["chunks"] == clean[1]["chunks"]


def test_racing_writers_get_numbers_of_their_own(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda _: Log(store).begin(), range(24)))
    assert sorted(numbers) == list(range(1, 25))

    def publish(_):
        try:
            Log(store).publish(5, "append")
        except Conflict:
            return 0
        return 1

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(publish, range(8))) == 1
    assert Log(store).published() == {5: "append"}
    with pytest.raises(ValueError, match="append or replace"):
        Log(store).publish(6, "other")


def test_racing_builds_are_seen_whole(spark, tmp_path, clean):
    store = Store(spark, str(tmp_path))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda _: flows.build_experts(store, *inputs(spark), mode="replace"), range(2)))
    assert held(store) == clean[1]
    versions = [r.version for r in store.read("expert_versions").collect()]
    assert len(set(versions)) == len(versions)


def test_racing_appends_lose_no_rows(spark, tmp_path):
    """To a table without partitions, and to one whose partitions' names need escapes."""
    store = Store(spark, str(tmp_path))

    def add(k):
        store.append("progress", spark.createDataFrame([(f"s{k}", k, 1, "x")], "slug string, seq long, stage int, payload string"))
        store.append("course_text", spark.createDataFrame([(f"s{k}", "hard", 1, "x", None, f"a/b:{k % 2} %c")], "slug string, difficulty string, k int, delta string, error string, batch string"))

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(add, range(16)))
    assert sorted(r.seq for r in store.read("progress").collect()) == list(range(16))
    assert sorted((r.slug, r.batch) for r in store.read("course_text").collect()) == sorted((f"s{k}", f"a/b:{k % 2} %c") for k in range(16))
    assert store.listed(f"{store.folder}/appending") == []
    # An append without rows makes a table of none.
    store.append("messages", store.read("messages"))
    assert store.read("messages", must_exist=True).count() == 0


def test_an_append_outlives_the_end_of_others(spark, tmp_path):
    """What Spark deletes in a table's folder as each append to it ends is nothing that another still needs."""
    store = Store(spark, str(tmp_path))
    late = F.udf(lambda k: time.sleep(2) or k, "long")
    rows = spark.range(0, 1, 1, 1).select(F.lit("a").alias("slug"), late("id").alias("seq"), F.lit(1).alias("stage"), F.lit("x").alias("payload"))
    with ThreadPoolExecutor(1) as pool:
        slow = pool.submit(store.append, "progress", rows)
        while not slow.done():
            store.delete(f"{store.path('progress')}/_temporary")
            time.sleep(0.02)
        slow.result()
    assert [r.seq for r in store.read("progress").collect()] == [0]


def test_a_turn_that_runs_again_counts_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    flows.build_experts(store, *inputs(spark))
    asked = spark.createDataFrame([("deep-sea", "do whales dive")], "slug string, text string")
    for turn in ("a", "a", "b", "b"):
        got = flows.converse(store, asked, turn=turn).collect()
        assert got[0].code == 200 and got[0].answer
    rows = store.read("messages").orderBy("seq").collect()
    assert [(r.seq, r.role, r.turn) for r in rows] == [(1, "user", "a-asked"), (2, "assistant", "a-answered"), (3, "user", "b-asked"), (4, "assistant", "b-answered")]
    # A reply that fails on the second run takes the first one's answer away.
    flows.converse(store, asked, Providers(answer=lambda context, question: F.lit(None).cast("string")), turn="b").collect()
    assert store.read("messages").count() == 3


def test_topics_of_one_slug_are_one_expert(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    topics = spark.createDataFrame([("Deep Sea",), ("deep  sea!",), ("Deep Sea",)], "topic string")
    got = flows.build_experts(store, topics, *inputs(spark)[1:]).collect()
    assert [(r.slug, r.topic, r.source_count) for r in got] == [("deep-sea", "Deep Sea", 4)]


def test_racing_updates_of_an_expert_lose_none(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = builds.compare_and_set(store, "a", None, topic="A", description="")
    with pytest.raises(Conflict, match="not None"):
        builds.compare_and_set(store, "a", None, topic="A")

    def add(name):
        """Adds its name to the description, looking again as often as another was faster."""
        while True:
            row = flows.registry.latest(store.read("expert_versions").where("slug = 'a'")).first()
            try:
                return builds.compare_and_set(store, "a", row.version, description=row.description + name)
            except Conflict:
                pass

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(add, "wxyz"))
    assert len({first, *versions}) == 5
    last = flows.registry.latest(store.read("expert_versions")).first()
    assert sorted(last.description) == list("wxyz") and last.version == max(versions) and last.topic == "A" and last.status == "pending"
    with pytest.raises(ValueError, match="no colour"):
        builds.compare_and_set(store, "b", None, colour="red")
    # The claim of a writer that was lost blocks until it is withdrawn.
    store.create(builds.claim_of(store, "b", None))
    with pytest.raises(Conflict, match="another writer"):
        builds.compare_and_set(store, "b", None, topic="B")
    assert builds.retake(store, "b", None) and builds.compare_and_set(store, "b", None, topic="B")
