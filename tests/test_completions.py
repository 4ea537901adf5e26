"""Streams of deltas, courses written as they come, conversations as state, turns as a stream."""

from __future__ import annotations

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chat, retrieval
from quillspark.plans import flows
from quillspark.providers import Providers, scripted
from quillspark.sources.store import Store
from quillspark.streaming import completions, conversations
from services_stub import service
from test_flows import inputs


def read_all(spark, folder, requests, **options):
    """All rows by now; the same folder goes on."""
    stream = completions.completions(spark, requests, **options)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.request_id, r.k, r.delta, r.error) for r in spark.read.schema(completions.SCHEMA).parquet(f"{folder}/rows").collect())


def ask(name, content, **more):
    return {"id": name, "system_prompt": "", "messages": [{"role": "user", "content": content}], **more}


def test_deltas_come_once(spark, tmp_path):
    told = {"a": [f"a{k} " for k in range(9)], "b": ["b "]}
    there = {"a": 3, "b": 0}

    def answer(path, query):
        name = query["id"]
        return {"available": there[name], "ended": there[name] == len(told[name]), "deltas": [{"delta": d} for d in told[name][int(query.get("from", 0)) : int(query.get("to", 0))]]}

    with service(answer) as (at, asked):
        requests = [ask("a", "x"), ask("b", "y")]
        options = {"endpoint": at, "model": "small", "max_tokens": "100"}
        assert read_all(spark, str(tmp_path), requests, **options) == [("a", k, f"a{k} ", None) for k in range(3)]
        given = json.loads(asked[0][1]["request"])
        assert (given["model"], given["max_tokens"]) == ("small", 100)
        there |= {"a": 9, "b": 1}
        del asked[:]
        assert read_all(spark, str(tmp_path), requests, **options) == [("a", k, f"a{k} ", None) for k in range(9)] + [("b", 0, "b ", None)]
        assert {(q["id"], q["from"], q["to"]) for _, q in asked if "from" in q} == {("a", "3", "9"), ("b", "0", "1")}
        assert len(read_all(spark, str(tmp_path), requests, **options)) == 10


def test_limit_and_model_of_a_request(spark, tmp_path):
    client = {"client": "quillspark.streaming.completions:offline"}
    text = "one two  three\nfour five "
    rows = read_all(spark, str(tmp_path / "a"), [ask("a", text, max_tokens=3), ask("b", text), ask("c", "")], max_tokens="100", **client)
    assert "".join(d for i, _, d, _ in rows if i == "a") == "one two  three" and "".join(d for i, _, d, _ in rows if i == "b") == text
    assert not any(i == "c" for i, *_ in rows) and scripted(" ", 5) == [" "]
    # A service that doesn't stop isn't followed beyond the limit.
    with service(lambda _, query: {"available": 1000, "ended": False, "deltas": [{"delta": "x "}] * (int(query.get("to", 0)) - int(query.get("from", 0)))}) as (at, _):
        assert len(read_all(spark, str(tmp_path / "b"), [ask("a", "", max_tokens=7)], endpoint=at)) == 8
    with pytest.raises(Exception, match="either an endpoint or a client"):
        read_all(spark, str(tmp_path / "c"), [ask("a", "x")])


def courses_asked(spark):
    return spark.createDataFrame([("deep-sea", "beginner", ""), ("deep-sea", "advanced", None), ("nobody", "beginner", None)], "slug string, difficulty string, focus string")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    own = Store(spark, str(tmp_path_factory.mktemp("store")))
    flows.build_experts(own, *inputs(spark))
    return own


def test_courses_are_written_as_they_come(spark, store, tmp_path):
    writer = completions.CourseWriter(store, courses_asked(spark), str(tmp_path / "run1"))
    writer.write_all(60)
    got = {(r.slug, r.difficulty): (r.code, r.text) for r in writer.text().collect()}
    want = {(r.slug, r.difficulty): (r.code, r.text) for r in flows.write_courses(store, courses_asked(spark)).collect()}
    assert got == want and got["nobody", "beginner"] == (404, None)


def test_a_course_that_breaks_off(spark, store, tmp_path):
    """The service stops in the middle of a course; the query that read it fails on the way and goes on from its checkpoint."""
    there, failing = {"n": 4}, {"left": 0}
    words = [f"word{k} " for k in range(10)]

    def answer(path, query):
        own = [{"delta": w} for w in words[: there["n"]]] + ([{"error": "broke off"}] if there["n"] == 6 else [])
        if "from" in query and failing["left"]:
            failing["left"] -= 1
            return 503
        return {"available": len(own), "ended": there["n"] == 6, "deltas": own[int(query.get("from", 0)) : int(query.get("to", 0))]}

    asked = courses_asked(spark).where("difficulty = 'beginner'")
    with service(answer) as (at, _):
        make = lambda: completions.CourseWriter(store, asked, str(tmp_path / "run2"), endpoint=at)
        text = lambda: {r.slug: r.text for r in make().text().collect()}["deep-sea"]
        make().write().awaitTermination()
        assert text() == "".join(words[:4])
        there["n"], failing["left"] = 6, 100
        with pytest.raises(Exception, match="503"):
            make().write().awaitTermination()
        assert text() == "".join(words[:4])
        failing["left"] = 0
        make().write_all(60)
        make().write_all(60)
        assert text() == "".join(words[:6]) + "\n\n**Error:** broke off"
        rows = store.read("course_text").where(F.col("batch").startswith("run2-")).orderBy("k").collect()
        assert [r.k for r in rows] == list(range(7))


def messages(spark, rows):
    return spark.createDataFrame(rows, "slug string, seq long, role string, content string, reset boolean")


def histories_of(rows, most):
    out, held, n = {}, {}, {}
    for slug, seq, role, content, reset in sorted(rows, key=lambda r: r[1]):
        if reset:
            held[slug], n[slug] = [], 0
        own = held.setdefault(slug, [])
        n[slug] = n.get(slug, 0) + 1
        out[slug, seq] = (len(own), hashlib.md5("|".join(own).encode()).hexdigest(), n[slug])
        held[slug] = [*own, f"{role}:{content}"][-most:]
    return out


def test_histories_over_batches_and_resets(spark, tmp_path):
    rows = [(f"s{k % 3}", k, "user" if k % 2 else "assistant", f"text {k}", k == 61 or (k == 10 and None)) for k in range(100)]
    rows = [(*r[:4], r[4] or None) for r in rows]
    place, folder = str(tmp_path / "in"), str(tmp_path / "run")
    for a, b in ((0, 25), (25, 70), (70, 100)):
        messages(spark, rows[a:b]).repartition(3).write.mode("append").parquet(place)
        got = conversations.history_stream(spark, spark.readStream.schema("slug string, seq long, role string, content string, reset boolean").parquet(place), folder)
        assert {(r.slug, r.seq): (r.n_history, r.history_md5, r.n_seen) for r in got.collect()} == histories_of(rows[:b], 20)
    # What is held now, read from the state: 13 since the reset, 20 of the others.
    state = {}
    for r in conversations.held(spark, folder).collect():
        state.setdefault(r.slug, []).append((r.seq, r.role, r.content))
    assert {s: sorted(x) for s, x in state.items()} == {s: [(q, role, c) for o, q, role, c, _ in rows if o == s and (s != "s1" or q >= 61)][-20:] for s in ("s0", "s1", "s2")}
    # The same as the windows of the batch operator, where nothing is reset.
    own = spark.createDataFrame([(s, q, role, c) for s, q, role, c, _ in rows if s == "s2"], "slug string, seq long, role string, text string")
    own = own.withColumn("seq", F.expr("(seq + 1) div 3"))
    want = {3 * r.seq - 1: "|".join(f"{m.role}:{m.content}" for m in r.history) for r in chat.with_history(own).collect()}
    last = {r.seq: r.history_md5 for r in got.where("slug = 's2'").collect()}
    assert last == {q: hashlib.md5(h.encode()).hexdigest() for q, h in want.items()}


def test_an_idle_conversation_is_emptied(spark, tmp_path):
    place, folder = str(tmp_path / "in"), str(tmp_path / "run")
    schema = "slug string, seq long, role string, content string, reset boolean"
    run = lambda: conversations.history_stream(spark, spark.readStream.schema(schema).parquet(place), folder, idle=1.0)
    messages(spark, [("a", 1, "user", "x", None), ("a", 2, "user", "y", None)]).write.parquet(place)
    run()
    assert conversations.held(spark, folder).count() == 2
    time.sleep(1.5)
    messages(spark, [("b", 3, "user", "z", None)]).write.mode("append").parquet(place)
    run()
    assert [r.slug for r in conversations.held(spark, folder).collect()] == ["b"]
    messages(spark, [("a", 4, "user", "again", None)]).write.mode("append").parquet(place)
    assert {r.seq: r.n_history for r in run().collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


def test_turns_as_a_stream(spark, store, tmp_path, monkeypatch):
    place, folder = str(tmp_path / "in"), str(tmp_path / "turns")
    schema = "slug string, seq long, text string"
    questions = lambda: spark.readStream.schema(schema).parquet(place)
    said = Providers(answer=lambda context, question: F.concat(F.lit("re: "), question))
    told = lambda: [(r.seq, r.role, r.content) for r in store.read("messages").where("expert_slug = 'deep-sea'").orderBy("seq").collect()]
    spark.createDataFrame([("deep-sea", 1, "one"), ("deep-sea", 2, "two"), ("nobody", 1, "x"), ("deep-sea", 3, " ")], schema).write.parquet(place)
    # The batch fails when its first answer is stored; the stream is started again.
    whole, left = flows.converse, [1]

    def once(*args, **named):
        if not left:
            return whole(*args, **named)
        whole(*args, **named).count()
        left.pop()
        raise RuntimeError("lost")

    monkeypatch.setattr(flows, "converse", once)
    with pytest.raises(Exception, match="lost"):
        conversations.turn_stream(store, questions(), folder, said)
    assert len(told()) == 2
    conversations.turn_stream(store, questions(), folder, said)
    want = [(1, "user", "one"), (2, "assistant", "re: one"), (3, "user", "two"), (4, "assistant", "re: two")]
    assert told() == want
    conversations.turn_stream(store, questions(), folder, said)
    conversations.answer_batch(store, spark.read.parquet(place), "turns-0", said)
    assert told() == want
    spark.createDataFrame([("deep-sea", 4, "three")], schema).write.mode("append").parquet(place)
    conversations.turn_stream(store, questions(), folder, said)
    assert told() == [*want, (5, "user", "three"), (6, "assistant", "re: three")]


def test_every_hit_counts_in_a_synthesis(spark):
    """Answers that keep the first word of each line: all hits are told of in the end, in any number of rounds."""
    hits = spark.createDataFrame([(q, r, f"w{q}x{r} " + "and so on " * 10) for q in (1, 2) for r in range(1, 12 * q)] + [(3, 1, " "), (4, 1, "single")], "query_id long, rank int, text string")
    asked = spark.createDataFrame([(q, "?") for q in range(1, 6)], "query_id long, question string")
    firsts = lambda context, _: F.array_join(F.transform(F.split(context, "\n"), lambda line: F.array_join(F.transform(F.filter(F.split(line, " "), lambda w: w.rlike("[0-9x]")), lambda w: w), " ")), " ")
    got = {r.query_id: r.answer for r in retrieval.synthesised(hits, asked, firsts, 250).collect()}
    assert got[1].split() == [f"w1x{r}" for r in range(1, 12)] and got[2].split() == [f"w2x{r}" for r in range(1, 24)]
    assert got[3] is None and got[5] is None and got[4] == ""
    # Answers as long as what they answer still end.
    same = {r.query_id: r.answer for r in retrieval.synthesised(hits, asked, lambda context, _: context, 250).collect()}
    assert same[2].count("w2x") == 23


def test_a_turn_told_by_packs(spark, store):
    asked = spark.createDataFrame([("deep-sea", "do whales dive")], "slug string, text string")
    spark.conf.set("quillspark.synthesis", "packs")
    try:
        got = flows.converse(store, asked, turn="packs").collect()
    finally:
        spark.conf.unset("quillspark.synthesis")
    assert got[0].code == 200 and "whales dive" in got[0].answer
    assert store.listed(f"{store.folder}/scratch") == []
