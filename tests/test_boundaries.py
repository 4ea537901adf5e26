"""Literal rows at the edges of each rule; what is expected follows from the rule in plain Python."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions import vectors as V
from quillspark.operators import chat, courses, frames, graph, registry, retrieval
from quillspark.providers import extract, hashed_embedding
from quillspark.sources import ingest
from quillspark.sources.store import Store
from quillspark.streaming.jobs import chat_stream

MAP = "map<string,string>"


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(f(F.col("v")), "i").orderBy("i").collect()]


def test_strip_equals_python(spark):
    values = ["", " ", "a", " a b ", " a　", "  x ", "\x1c\x1fy\x85", "​z", "\na\n", "😀 "]
    assert column(spark, values, X.strip) == [v.strip() for v in values]


@pytest.mark.parametrize("n", [99, 100, 101])
def test_least_length(spark, n):
    rows = spark.createDataFrame([("  " + "x" * n + "\n　",)], "text string")
    assert ingest.long_enough(rows, "text").count() == (n >= 100)


def test_least_length_blank_and_null(spark):
    rows = spark.createDataFrame([(" " * 200,), (None,), ("",)], "text string")
    assert ingest.long_enough(rows, "text").count() == 0


def test_web_sources(spark):
    long = " " + "é" * 11_998 + "😀z"
    rows = [("s", 1, "u1", None, long, None), ("s", 2, "u2", "", "y" * 100, None), ("s", 3, "u3", "t", "z" * 99, None)]
    got = ingest.web_sources(spark.createDataFrame(rows, f"slug string, rank int, url string, title string, text string, metadata {MAP}")).orderBy("rank").collect()
    assert [(r.title, r.content) for r in got] == [("u1", long[:12_000]), ("u2", "y" * 100)]


def test_crawl_title_only_where_absent(spark):
    body = "<p>" + "w " * 100 + "</p>"
    rows = [("u1", f"<title>T</title>{body}"), ("u2", f"<title></title>{body}"), ("u3", body), ("u4", "<p>short</p>"), ("u5", None)]
    got = {r.url: r.title for r in ingest.crawled(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {"u1": "T", "u2": "", "u3": "u3"}


def test_enriched_replaces_whole_rows(spark):
    sources = spark.createDataFrame([("s", k, f"u{k}", f"t{k}", f"c{k}", "web", {"score": "1"}) for k in range(1, 8)], f"slug string, rank int, url string, title string, content string, source_type string, metadata {MAP}")
    crawls = spark.createDataFrame([(f"u{k}", None if k == 2 else f"T{k}", f"C{k}") for k in (2, 5, 6)], "url string, title string, content string")
    got = ingest.enriched(sources, crawls).orderBy("rank").collect()
    assert [(r.rank, r.content, r.title, r.source_type, r.metadata) for r in got] == [
        (k, f"C{k}", None if k == 2 else f"T{k}", "crawl", {}) if k in (2, 5) else (k, f"c{k}", f"t{k}", "web", {"score": "1"}) for k in range(1, 8)
    ]


def test_provider_metadata_wins(spark):
    df = spark.createDataFrame([("u", "t", "web", {"title": "mine", "x": "1"}), ("u", "t", "web", {})], f"url string, title string, kind string, m {MAP}")
    got = [r[0] for r in df.select(ingest.merged_metadata(F.col("url"), F.col("title"), F.col("kind"), F.col("m"))).collect()]
    assert got == [{"url": "u", "title": "mine", "source_type": "web", "x": "1"}, {"url": "u", "title": "t", "source_type": "web"}]


def test_elements(spark):
    got = column(spark, [["a" * 24, " ", "b" * 23], ["a" * 24, " ", "b" * 24], [], None], ingest.file_text, "array<string>")
    assert got == [None, "a" * 24 + "\n\n" + "b" * 24, None, None]


def test_video_id(spark):
    code = "aB3_-567890"
    urls = [f"https://v.example/watch?v={code}", f"https://youtu.be/{code}", f"https://v.example/embed/{code}?t=1", "https://a.bc/short", "https://e.org/wiki/Quantum_computing", None]
    assert column(spark, urls, X.video_id) == [code, code, code, None, "Quantum_com", None]


def test_slug(spark):
    spelt = {"Straße Ærø": "strasse-aero", "Ελλάδα θάλασσα": "ellada-thalassa", "Москва, щука и объём": "moskva-shchuka-i-obiom", "Łódź Şişli": "lodz-sisli", "Жюль Верн": "zhiul-vern", "Київ": "kiyiv", "日本": None}
    assert column(spark, list(spelt), X.slug) == list(spelt.values())
    assert column(spark, ["Crème Brûlée!", "  ", "a--B", "¿?", None, "Ünïcode 42"], X.slug) == ["creme-brulee", None, "a-b", None, None, "unicode-42"]


def test_preview(spark):
    assert column(spark, ["", None, "x" * 160, "x" * 161], X.preview) == ["No description yet."] * 2 + ["x" * 160, "x" * 160 + "..."]


@pytest.mark.parametrize(("n", "k"), [(1, 1), (512, 1), (513, 2), (960, 2), (961, 3)])
def test_chunks(spark, n, k):
    words = [f"w{i}" for i in range(n)]
    got = graph.chunks(spark.createDataFrame([("s", 1, "\n".join(words))], "slug string, doc_id long, text string")).orderBy("chunk_id").collect()
    assert [r.text.split(" ") for r in got] == [words[i * 448 : i * 448 + 512] for i in range(k)]


def test_blank_documents_have_no_chunks(spark):
    assert graph.chunks(spark.createDataFrame([("s", 1, "  "), ("s", 2, None)], "slug string, doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17])
def test_path_cap(spark, n):
    chunked = spark.createDataFrame([("s", 1, 0, " ".join(f"w{i}" for i in range(n)))], "slug string, doc_id long, chunk_id int, text string")
    assert graph.extracted_paths(chunked).count() == min(15, n - 1)


def test_stats_default(spark):
    paths = spark.createDataFrame([("a", "x", "R", "y"), ("a", "x", "R", "y"), ("a", "y", "R", "x")], "slug string, src string, rel string, dst string")
    got = {r.slug: (r.node_count, r.relation_count) for r in graph.graph_stats(spark.createDataFrame([("a",), ("b",)], "slug string"), paths).collect()}
    assert got == {"a": (2, 2), "b": (0, 0)}


def test_expand_two_steps(spark):
    edges = spark.createDataFrame([("s", "a", "R", "b"), ("s", "b", "R", "c"), ("t", "a", "R", "z")], "slug string, src string, rel string, dst string")
    seeds = spark.createDataFrame([(1, "s", "a")], "q int, slug string, node string")
    got = {(r.hop, r.rel, r.node) for r in graph.expand(seeds, edges, 2).collect()}
    assert got == {(1, "R", "b"), (2, "R^-1", "a"), (2, "R", "c")}


def test_top_k_ties_and_namespaces(spark):
    rows = [(i, "n", [1.0, 0.0]) for i in range(4)] + [(9, "n", [0.0, 1.0]), (10, "m", [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, namespace string, embedding array<float>")
    got = retrieval.top_k(vectors.where("vec_id = 3"), vectors, k=5, by=["namespace"], query_block=1, vector_block=2).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 9]
    assert retrieval.top_k(vectors.where("vec_id < 0"), vectors).count() == 0


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert math.isclose(got[0], 0.96) and got[1] is None


@pytest.mark.parametrize("n", [0, 2999, 3000, 3001])
def test_context(spark, n):
    hits = spark.createDataFrame([(1, 1, "x" * n)], "query_id int, rank int, text string")
    got = retrieval.assembled(hits).first().context
    assert got == ("" if not n else "\n\n[knowledge]\n" + "x" * min(n, 3000) + "\n[/knowledge]")


def told(spark, roles, slug="s", per=8):
    rows = [(slug, i // per, i % per, role, f"t{i}") for i, role in enumerate(roles)]
    return chat.numbered(spark.createDataFrame(rows, "slug string, conv_id long, turn long, role string, text string"), conversations_per_block=2)


@pytest.mark.parametrize("n", [1, 20, 21, 22, 60])
def test_history_window(spark, n):
    got = chat.with_history(told(spark, ["user"] * n), block=25).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, n + 1))
    assert [[m.content for m in r.history] for r in got] == [[f"t{j}" for j in range(max(0, i - 20), i)] for i in range(n)]


def test_orphans_and_reset(spark):
    own = told(spark, ["user", "user", "assistant", "user"])
    assert sorted(r.seq for r in chat.orphans(own).collect()) == [1, 4]
    assert chat.reset(own, spark.createDataFrame([("s",), ("none",)], "slug string")).count() == 0


def test_append_and_reply(spark):
    own = told(spark, ["user"])
    deltas = spark.createDataFrame([("s", 2, "lo", False), ("s", 1, "hel", False), ("t", 1, "x", True)], "slug string, k int, delta string, failed boolean")
    reply = chat.reply(deltas)
    assert [(r.slug, r.text) for r in reply.collect()] == [("s", "hello")]
    assert chat.appended(own, reply.withColumn("k", F.lit(1))).first().seq == 2


def test_gates(spark):
    rows = [("chat", None, ""), ("chat", "building", ""), ("chat", "ready", "  "), ("chat", "ready", "hi"), ("course", None, ""), ("course", "failed", ""), ("course", "ready", ""), ("history", None, ""), ("history", "failed", ""), ("reset", None, None), ("create", None, " ")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, status string, message string")
    got = [r[0] for r in df.select(registry.gate_code(F.col("kind"), F.col("status"), F.col("message")), "i").orderBy("i").collect()]
    assert got == [404, 409, 400, 200, 404, 409, 200, 404, 200, 200, 400]


def test_create_and_finish(spark):
    experts = spark.createDataFrame([("a", "ready"), ("b", "failed"), ("c", "building")], "slug string, status string")
    asked = spark.createDataFrame([(x,) for x in "abcdd"], "slug string")
    assert {r.slug: r.action for r in registry.to_build(asked, experts).collect()} == {"a": "skip", "b": "rebuild", "c": "rebuild", "d": "build"}
    assert [r.slug for r in registry.new_expert(spark.createDataFrame([("¡Olé!",), ("??",)], "topic string")).collect()] == ["ole"]


def test_modules_and_focus(spark):
    experts = spark.createDataFrame([("s", "T", "d" * 501, 1, 2)], "slug string, topic string, description string, node_count long, relation_count long")
    asked = spark.createDataFrame([("s", "beginner", "f"), ("s", "intermediate", ""), ("s", "advanced", None), ("s", "custom", None)], "slug string, difficulty string, focus string")
    plans = courses.plan(experts, asked)
    got = {r.difficulty: r for r in plans.collect()}
    assert {k: r.n_modules for k, r in got.items()} == {"beginner": 4, "intermediate": 6, "advanced": 8, "custom": 6}
    assert [k for k, r in got.items() if "Focus" in r.prompt] == ["beginner"]
    assert all("d" * 500 in r.prompt and "d" * 501 not in r.prompt for r in got.values())
    course = courses.parsed(courses.rendered(plans)).where("difficulty = 'beginner'").first().course
    assert course.title == "T" and course.introduction == "What is coming." and len(course.modules) == 4 and course.modules[0].content == "Text of the part."


def test_frames(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "[DONE]"), (3, "[ERROR] x"), (4, "")], "k int, t string")
    legacy, spec = (frames.parsed(df.select("k", frames.frame(F.col("t"), m).alias("raw")), ["k"]) for m in ("legacy", "spec"))
    assert [r.data for r in legacy.where("k = 1").collect()] == ["a"]
    assert [r.data for r in spec.where("k = 1").orderBy("line_no").collect()] == ["a", "b"]
    assert {r.k: r.kind for r in spec.collect()} == {1: "data", 2: "done", 3: "error", 4: "data"}


def test_source_errors(spark):
    empty = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ingest.SourceError):
        ingest.read_source(lambda: spark.read.parquet("/none"), empty)
    assert ingest.read_source(lambda: spark.read.parquet("/none"), empty, "skip").count() == 0


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("vectors").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.read("chunks", must_exist=True)
    rows = lambda *x: spark.createDataFrame([Row(namespace=n, vec_id=i, embedding=[1.0], metadata={}) for n, i in x], "namespace string, vec_id long, embedding array<float>, metadata map<string,string>")
    store.append("vectors", rows(("a", 1), ("b", 2)))
    store.append("vectors", rows(("a", 1)))
    assert store.read("vectors").count() == 3
    store.replace("vectors", rows(("a", 5)))
    assert sorted((r.namespace, r.vec_id) for r in store.read("vectors").collect()) == [("a", 5), ("b", 2)]
    assert "PartitionFilters: [isnotnull(namespace" in store.read("vectors").where("namespace = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert store.create_vector_table("vectors_made_once") and not store.create_vector_table("vectors_made_once")


def test_providers(spark):
    got = column(spark, ["a b a", "", None], hashed_embedding)
    assert math.isclose(sum(x * x for x in got[0]), 1, rel_tol=1e-6) and got[1] is None and got[2] is None
    assert column(spark, ["  c ", ""], lambda c: extract(c, F.lit("q"))) == ["c", "Nothing is known about: q"]


def test_an_embedding_reads_its_text_once(spark):
    words = [f"w{k % 37}" for k in range(600)]
    (got,) = column(spark, [" ".join(words)], hashed_embedding)
    cells = [r.c for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.pmod(F.xxhash64("w"), F.lit(128)).alias("c")).collect()]
    counts = [cells.count(i) - cells.count(i + 64) for i in range(64)]
    length = sum(x * x for x in counts) ** 0.5
    assert got == pytest.approx([x / length for x in counts], rel=1e-6)
    # What stands inside a function of an array is computed for each of its elements, so no expression may be written out again there.
    plan = spark.range(1).select(hashed_embedding(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("xxhash64(") == 1


def test_chat_stream_over_batches_equals_one(spark, tmp_path):
    rows = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"{c}.{t}") for c in range(3) for t in range(30)], "conv_id long, turn long, role string, text string")
    rows.where("turn < 17").coalesce(1).write.parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "work")
    chat_stream(spark, str(tmp_path / "in"), folder)
    rows.where("turn >= 17").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    twice = sorted(chat_stream(spark, str(tmp_path / "in"), folder).collect())
    assert twice == sorted(chat_stream(spark, str(tmp_path / "in")).collect())
    assert [(r.n_messages, r.n_history, r.last_role) for r in twice] == [(30, 20, "assistant")] * 3


def test_settings(spark):
    from quillspark.settings import settings

    spark.conf.set("quillspark.top_k", "7")
    assert settings(spark).top_k == 7 and settings(spark).history == 20
    spark.conf.unset("quillspark.top_k")


def test_numbers_of_a_long_conversation_come_from_its_parts(spark):
    rows = [("s", c, t, "user", "x") for c in (1, 2, 7) for t in range(25)]
    df = spark.createDataFrame(rows, "slug string, conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.seq for r in chat.numbered(df, conversations_per_block=2, turns_per_part=4).collect()}
    assert got == {(c, t): 25 * k + t + 1 for k, c in enumerate((1, 2, 7)) for t in range(25)}


def test_many_queries_meet_vectors_in_a_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<double>")
    few = {tuple(r) for r in retrieval.top_k(rows, rows, 3).collect()}
    monkeypatch.setattr(retrieval, "FEW_QUERIES", 5)
    assert {tuple(r) for r in retrieval.top_k(rows, rows, 3, query_block=16, vector_block=16).collect()} == few


def test_transcripts_gather_what_the_cut_can_reach(spark):
    rows = [(1, k, "x" * 99) for k in range(400)] + [(2, k, " " * 500) for k in range(60)] + [(2, 60 + k, "word" * 9) for k in range(4)]
    rows += [(3, 0, "a" * 50), (3, 1, None), (3, 2, "b" * 49), (4, 0, "a" * 49), (4, 1, "b" * 49), (5, 0, " "), (6, 0, "t" * 200), (6, 0, "s" * 200)]
    df = spark.createDataFrame(rows, "k long, seq int, text string")
    got = {r.k: r.content for r in ingest.transcripts(df, "k", "seq", "text").collect()}
    want = {}
    for k in range(1, 7):
        whole = " ".join(t for _, _, t in sorted((r for r in rows if r[0] == k and r[2] is not None)))
        if len(whole.strip()) >= 100:
            want[k] = whole[:15_000]
    assert got == want and set(got) == {1, 2, 3, 6}


def test_a_text_whose_words_cancel_has_a_vector(spark):
    """Of each pair the hashes are the same component with other signs."""
    values = ["sand salt", "Salt sand sand SALT", "they stones sand salt", "sand salt salt", " \n", None]
    cell = {r.w: r.c for r in spark.createDataFrame([(w,) for w in ("sand", "salt", "they", "stones")], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(128)).cast("int").alias("c")).collect()}
    assert abs(cell["sand"] - cell["salt"]) == abs(cell["they"] - cell["stones"]) == 64
    a, b = cell["sand"] % 64, cell["they"] % 64
    one, two = ([1.0 if i == a else 0.0 for i in range(64)], [0.5**0.5 if i in (a, b) else 0.0 for i in range(64)])
    got = column(spark, values, hashed_embedding)
    assert got[0] == got[1] == one and got[2] == pytest.approx(two, rel=1e-6)
    # One that doesn't cancel keeps its signs.
    assert got[3] == [x * (1 if cell["salt"] < 64 else -1) for x in one]
    assert got[4] is None and got[5] is None
