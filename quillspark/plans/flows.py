"""Whole flows: building experts, and answering questions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chat, courses, frames, graph, registry, retrieval, sentences
from ..operators.courses import persona_prompt, title_prompt
from ..providers import Providers, chosen
from ..settings import Settings, settings
from ..sources import ingest
from ..sources.builds import Build, Log
from ..sources.store import Store


def build_experts(
    store: Store,
    topics: DataFrame,
    sources: DataFrame | Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]],
    crawls: DataFrame | None = None,
    papers: DataFrame | None = None,
    providers: Providers | None = None,
    version: int = 1,
    mode: str = "append",
    resume: int | None = None,
) -> DataFrame:
    """Build every expert of ``topics`` (topic) that isn't ready: sources, chunks, graph, vectors, registry.

    ``sources`` and ``papers`` have the columns of source documents, ``crawls`` (url,
    title, content); or ``sources`` is a function that gives all three for the experts being built (slug, topic), and fails the build if it
    fails. All experts are built by one set of jobs, as one transaction: readers see all of a build's tables or none, and
    a build that failed leaves nothing behind that a later one would count. Its number is the next of the log, ``version`` at least. ``mode``
    says whether a rebuilt expert's vectors are added to what is there or replace it; its other tables are always replaced. What a build
    tells goes to table ``progress``. If a job fails, the experts are marked failed, a last frame says why, and the error
    is raised; ``resume`` names such a build of the same topics and the same input, whose finished tables are taken over.
    Limits come from the session's settings. Gives the registry's latest rows.
    """
    providers, said, log = providers or chosen(store.spark), settings(store.spark), Log(store)
    known = registry.latest(store.read("expert_versions"))
    wanted = registry.new_expert(topics.select("topic").distinct(), said.namespace_prefix, said.storage)
    # Topics that differ in signs alone are one expert, by the least of them.
    first = wanted.groupBy("slug").agg(F.min("topic").alias("topic"))
    wanted = wanted.join(first, ["slug", "topic"], "left_semi")
    action = registry.to_build(wanted, known)
    number = log.begin(version)
    now, before = 2 * number, lambda n: F.lit(n).cast("long").alias("version")
    building = wanted.join(action.where("action <> 'skip'").select("slug"), "slug", "left_semi").withColumn("created_at", F.current_timestamp())
    store.append("expert_versions", building.select("*", before(now)))
    building = store.read("expert_versions").where(F.col("version") == now)
    build = Build(store, number)
    try:
        if resume is not None and _same_targets(building, Build(store, resume)):
            build.adopt(resume)
        targets = build.stage("targets", lambda: building.select("slug", F.concat(F.lit(said.namespace_prefix + "-"), "slug").alias("namespace")))
        every = build.stage("sources", lambda: _all_sources(targets, *(sources(building) if callable(sources) else (sources, crawls, papers)), said))
        chunked = build.stage("chunks", lambda: _chunks(_documents(every), said))
        paths = build.stage("relations", lambda: graph.graph_of(chunked, providers.paths, said.max_paths_per_chunk))
        build.stage("nodes", lambda: graph.nodes(paths).select("slug", "node_id", F.lit("entity").alias("label"), F.create_map().cast("map<string,string>").alias("properties")))
        build.stage("vectors", lambda: _vectors(chunked, providers, said))
        described = title_prompt(every).select("slug", F.concat(F.lit("Made of:\n"), "bullets").alias("made_of"))
        done = registry.finished(building, graph.graph_stats(building, paths), every).join(described, "slug", "left").withColumn("description", F.coalesce("made_of", F.concat(F.lit("All about "), "topic")))
        ready = build.stage("expert_versions", lambda: done.drop("version").select("*", before(now + 1)))
        build.stage("progress", lambda: frames.progress(ready))
        log.publish(number, mode)
    except Exception as why:
        store.append("progress", building.select("slug", F.lit(1).cast("long").alias("seq"), F.lit(0).alias("stage"), F.lit(f"{frames.ERRORS['build']}{why}").alias("payload")))
        store.append("expert_versions", registry.failed(building).drop("version").select("*", before(now + 1)))
        raise
    return registry.latest(store.read("expert_versions"))


def _same_targets(building: DataFrame, other: Build) -> bool:
    """Whether a build was of the same experts; one that hadn't come as far as to name them was not."""
    if not other.staged("targets"):
        return False
    mine, its = building.select("slug"), other.read("targets").select("slug")
    return mine.join(its, "slug", "full").where(mine["slug"].isNull() | its["slug"].isNull()).isEmpty()


def _all_sources(targets: DataFrame, sources: DataFrame, crawls: DataFrame, papers: DataFrame, said: Settings) -> DataFrame:
    """The first sources of each expert, enriched, then its papers, whether it has sources or not."""
    mine = sources.join(targets.select("slug"), "slug", "left_semi")
    found = ingest.enriched(mine.where(F.col("rank") <= said.max_sources), crawls, first=said.crawls)
    last = found.groupBy("slug").agg(F.max("rank").alias("last"))
    own = papers.where(F.col("rank") <= said.papers).join(targets.select("slug"), "slug", "left_semi").join(last, "slug", "left")
    more = own.withColumn("rank", (F.col("rank") + F.coalesce("last", F.lit(0))).cast("int"))
    return ingest.all_sources(found.select(ingest.SOURCE_COLUMNS), more.select(ingest.SOURCE_COLUMNS))


def _documents(every: DataFrame) -> DataFrame:
    merged = ingest.merged_metadata(F.col("url"), F.col("title"), F.col("source_type"), F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    return ingest.indexable(every).select("slug", F.xxhash64("slug", "rank").alias("doc_id"), F.col("content").alias("text"), merged.alias("metadata"))


def _chunks(docs: DataFrame, said: Settings) -> DataFrame:
    """Windows of words, or, as the settings say, chunks that end where sentences do."""
    sizes = (docs, said.chunk_tokens, said.chunk_overlap, ("slug", "metadata"))
    if said.chunks == "sentences":
        return sentences.sentence_chunks(*sizes, vocabulary=said.chunk_vocabulary or None)
    if said.chunks != "windows":
        raise ValueError(f"quillspark.chunks must be windows or sentences, not {said.chunks!r}")
    return graph.chunks(*sizes)


def _vectors(chunked: DataFrame, providers: Providers, said: Settings) -> DataFrame:
    namespace = F.concat(F.lit(said.namespace_prefix + "-"), "slug").alias("namespace")
    return chunked.select(namespace, F.xxhash64("doc_id", "chunk_id").alias("vec_id"), providers.embed(F.col("text")).alias("embedding"), "metadata").where("embedding is not null")


#: Up to so many experts asked at once are named in the filters of what is read for them, so that other partitions aren't listed.
NAMED = 1000


def converse(store: Store, questions: DataFrame, providers: Providers | None = None, turn: str | None = None) -> DataFrame:
    """(slug, code, answer): a whole turn of each expert that is asked. ``questions`` has slug and text, one for a slug.

    What the gate refuses gets its code and leaves no trace. Else the question is stored as a message first;
    then come the nearest chunks, one step in the graph, the last messages and the answer, which is stored
    only where there is one: a question whose reply fails stays without. A turn that is run again under the same name
    (``turn``) replaces the messages that it stored before, so it counts once.
    """
    providers, said, turn = providers or chosen(store.spark), settings(store.spark), turn or uuid.uuid4().hex
    asked_as, answered_as = f"{turn}-asked", f"{turn}-answered"
    experts = registry.present(registry.latest(store.read("expert_versions")))
    asked = questions.select("slug", "text").join(experts.select("slug", "status"), "slug", "left")
    asked = asked.withColumn("code", registry.gate_code(F.lit("chat"), F.col("status"), F.col("text"))).select("slug", "text", "code")
    passed = asked.where("code = 200").withColumn("query_id", F.xxhash64("slug"))
    named = [r.slug for r in passed.select("slug").distinct().limit(NAMED + 1).collect()]
    only = (lambda rows, column, prefix="": rows.where(F.col(column).isin([prefix + x for x in named]))) if len(named) <= NAMED else (lambda rows, *_: rows)
    message = lambda rows, role, content, name: rows.select(F.col("slug").alias("expert_slug"), F.col("seq").cast("long").alias("seq"), F.lit(role).alias("role"), F.col(content).alias("content"), F.current_timestamp().alias("ts"), F.lit(name).alias("turn"))
    told = lambda: only(store.read("messages"), "expert_slug").select(F.col("expert_slug").alias("slug"), "seq", "role", F.col("content").alias("text"), "turn")
    forget_turn(store, turn)  # an empty table would replace nothing
    before = told().where(~F.col("turn").isin(asked_as, answered_as))
    store.replace("messages", message(chat.appended(before, passed.withColumn("k", F.lit(1))), "user", "text", asked_as))
    own = told().where(F.col("turn") == asked_as).groupBy("slug").agg(F.max("seq").alias("own"))
    turns = own.join(passed, "slug")
    history = last_messages(before.join(own, "slug").where("seq < own").drop("own", "turn"), said.history)
    namespace = F.concat(F.lit(said.namespace_prefix + "-"), "slug").alias("namespace")
    wanted = passed.select(namespace, F.col("query_id").alias("vec_id"), providers.embed(F.col("text")).alias("embedding")).where("embedding is not null")
    near = retrieval.top_k(wanted, only(store.read("vectors"), "namespace", said.namespace_prefix + "-").select("namespace", "vec_id", "embedding"), said.top_k, ["namespace"])
    held = only(store.read("chunks"), "slug").select(F.xxhash64("doc_id", "chunk_id").alias("vec_id"), "slug", "text", graph.chunk_node(F.col("doc_id"), F.col("chunk_id")).alias("node"))
    hits = near.join(held, "vec_id").select("query_id", "rank", "slug", "node", "text")
    if said.synthesis not in ("first", "packs"):
        raise ValueError(f"quillspark.synthesis must be first or packs, not {said.synthesis!r}")
    scratch, context = store.scratch(), None
    if said.synthesis == "packs":
        told = retrieval.synthesised(scratch("hits", hits), passed.select("query_id", F.col("text").alias("question")), providers.answer, said.context_chars, keep=scratch)
        context = retrieval.framed(told.select("query_id", F.col("answer").alias("joined")))
    payloads = turn_payloads(passed.select("query_id", "slug", "text"), experts, hits, only(store.read("relations"), "slug"), history, said.near_nodes, said.context_chars, context)
    answered = payloads.join(turns.select("query_id", "text", "own"), "query_id").select("slug", (F.col("own") + 1).alias("seq"), providers.answer(F.col("system_prompt"), F.col("text")).alias("answer"))
    store.replace("messages", message(answered.where("answer is not null"), "assistant", "answer", answered_as))
    scratch.forget()
    last = store.read("messages").where(F.col("turn") == answered_as).select(F.col("expert_slug").alias("slug"), F.col("content").alias("answer"))
    return asked.join(last, "slug", "left").select("slug", "code", "answer")


def forget_turn(store: Store, turn: str) -> None:
    """Delete what a turn of this name stored."""
    for what in ("asked", "answered"):
        store.delete(f"{store.path('messages')}/turn={turn}-{what}")


def write_courses(store: Store, requests: DataFrame, providers: Providers | None = None) -> DataFrame:
    """(slug, difficulty, code, text): courses asked for by (slug, difficulty, focus), written piece by piece.

    The pieces go to table ``course_text`` as plain text; a course that breaks off ends with what went wrong.
    """
    providers, batch = providers or chosen(store.spark), uuid.uuid4().hex
    experts = registry.present(registry.latest(store.read("expert_versions")))
    asked = requests.select("slug", "difficulty", "focus").join(experts.select("slug", "status"), "slug", "left")
    asked = asked.withColumn("code", registry.gate_code(F.lit("course"), F.col("status"), F.lit(""))).drop("status")
    plans = courses.rendered(courses.plan(experts, asked.where("code = 200").select("slug", "difficulty", "focus")))
    store.append("course_text", courses.deltas(plans, providers.deltas).select("*", F.lit(None).cast("string").alias("error"), F.lit(batch).alias("batch")))
    text = courses.plain_text(store.read("course_text").where(F.col("batch") == batch), ["slug", "difficulty"])
    return asked.select("slug", "difficulty", "code").join(text, ["slug", "difficulty"], "left")


def turn_payloads(questions: DataFrame, experts: DataFrame, hits: DataFrame, edges: DataFrame, history: DataFrame, near_nodes: int = 20, context_chars: int = retrieval.CONTEXT_CHARS, context: DataFrame | None = None) -> DataFrame:
    """(query_id, slug, system_prompt, messages): what goes to a model for each question.

    ``questions`` has query_id, slug and text; ``hits`` query_id, rank, node and text of
    what was found; ``edges`` the expert's relations; ``history`` (slug, messages before).
    What the graph holds one step from a hit is named after the hits' texts, ``near_nodes`` names at most, first by the alphabet; of the
    hits' texts ``context_chars`` characters are told, or ``context`` (query_id, context) instead.
    """
    near = graph.expand(hits.select("query_id", "slug", "node"), edges).groupBy("query_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("node")), 1, near_nodes), ", ").alias("near"))
    context = (retrieval.assembled(hits, most=context_chars) if context is None else context).join(near, "query_id", "left")
    full = questions.join(context, "query_id", "left").join(experts.select("slug", "topic", "description"), "slug", "left").join(history, "slug", "left")
    prompt = F.concat(persona_prompt(F.coalesce("topic", "slug"), F.col("description")), F.coalesce("context", F.lit("")), F.coalesce(F.concat(F.lit("\nNear by: "), "near"), F.lit("")))
    own = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    return full.select("query_id", "slug", prompt.alias("system_prompt"), F.concat(F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")), own).alias("messages"))


def last_messages(numbered: DataFrame, most: int = chat.HISTORY) -> DataFrame:
    """(slug, history): each slug's last messages in order. Each task cuts to its own last ones first."""
    size = numbered.groupBy("slug").agg(F.max("seq").alias("n"))
    few = numbered.join(size, "slug").where(F.col("seq") > F.col("n") - most)
    listed = few.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))).alias("m"))
    return listed.select("slug", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("history"))
