"""The catalogue: each query runs an operator over whole tables of ``sf_dir``.

``documents.source`` stands for an expert, a document for a source document ranked by
its id, ``pages`` for crawl results (those with ``page_id % 3 = 0`` failed), ``events``
for registry versions, ``conversations`` for messages of five experts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..functions import vectors as V
from ..operators import chat, courses, frames, graph, registry, retrieval
from . import flows
from ..providers import Providers, paragraphs
from ..sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MAP = "map<string,string>"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("source", "slug")


def first_line(text: Column) -> Column:
    return F.substring(F.element_at(F.split(text, "\n"), 1), 1, 60)


def as_sources(docs: DataFrame) -> DataFrame:
    """Documents as source documents; ranks are by id."""
    url = F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    own = docs.select("slug", "doc_id", url.alias("url"), first_line(F.col("text")).alias("title"), F.col("text").alias("content"), F.lit("web").alias("source_type"), F.create_map(F.lit("score"), F.col("n_chars").cast("string")).alias("metadata"))
    return ingest.ranked(own, "slug", "doc_id")


@query
def src_min_length_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ingest.long_enough(documents(spark, sf_dir), "text")
    content = X.cut(F.col("text"), ingest.WEB_CHARS)
    return kept.select("doc_id", F.length(content).alias("n"), F.md5(content).alias("content_md5"))


@query
def src_title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", H.title(F.col("html")).alias("page_title"))
    hits = documents(spark, sf_dir).select("doc_id").join(pages, "doc_id", "left").withColumn("url", F.coalesce("url", F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))))
    given = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, None).otherwise(F.col("page_title"))
    return hits.select("doc_id", "url", X.or_else(given, F.col("url")).alias("title"))


@query
def src_topn_per_expert(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ingest.long_enough(documents(spark, sf_dir), "text").select("slug", "doc_id")
    return ingest.top_ranked(kept, "slug", ingest.MAX_SOURCES, "doc_id").select("slug", "doc_id", "rank")


@query
def src_crawl_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.crawled(table(spark, sf_dir, "pages"))
    return out.select("page_id", "title", F.length("content").alias("n"), F.md5("content").alias("content_md5"))


@query
def src_enrich_first5(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawls = ingest.crawled(table(spark, sf_dir, "pages").where("page_id % 3 <> 0")).withColumnRenamed("page_id", "doc_id")
    # The test tables join pages to documents by id; the id replaces the url as the key.
    sources = ingest.top_ranked(as_sources(documents(spark, sf_dir)).drop("rank"), "slug", ingest.MAX_SOURCES, "doc_id")
    out = ingest.enriched(sources, crawls, key="doc_id")
    return out.select("slug", "rank", "url", "title", "source_type", F.md5("content").alias("content_md5"), F.size("metadata").alias("n_metadata"))


@query
def src_paper_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("slug", "doc_id", "lang", "n_chars", "text")
    top = ingest.top_ranked(docs, "slug", ingest.PAPERS, F.desc("n_chars"), "doc_id")
    content = ingest.paper(first_line(F.col("text")), F.array("slug", "lang"), F.substring("text", 1, 200), F.col("n_chars").cast("string"))
    return top.select("slug", "rank", "doc_id", F.md5(content).alias("content_md5"))


@query
def src_video_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.substring(F.md5(F.col("page_id").cast("string")), 1, 11)
    urls = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://video.example/watch?v="), code))
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit("https://youtu.be/"), code))
        .when(F.col("page_id") % 5 == 2, F.concat(F.lit("https://video.example/embed/"), code, F.lit("?t=1")))
        .when(F.col("page_id") % 5 == 3, F.concat(F.lit("https://a.bc/"), F.substring(code, 1, 10)))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", urls.alias("video_url"), X.video_id(urls).alias("video_id"))


@query
def src_transcript_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.transcripts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    title = X.or_else(F.when(F.col("conv_id") % 2 == 0, F.lit("")), F.concat(F.lit("YouTube: "), F.col("conv_id").cast("string")))
    return out.select("conv_id", title.alias("title"), F.length("content").alias("n"), F.md5("content").alias("content_md5"))


@query
def src_elements_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/in/"), F.col("slug"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    read = documents(spark, sf_dir).select("doc_id", path.alias("path"), ingest.file_text(F.split("text", "\n")).alias("content"))
    return read.where("content is not null").select("doc_id", X.base_name(F.col("path")).alias("title"), F.concat(F.lit("file://"), "path").alias("url"), F.length("content").alias("n"), F.md5("content").alias("content_md5"))


@query
def src_union_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = ingest.long_enough(documents(spark, sf_dir), "text").select(F.lit("web").alias("source_type"), X.cut(F.col("text"), ingest.WEB_CHARS).alias("content"))
    crawl = ingest.crawled(table(spark, sf_dir, "pages")).select(F.lit("crawl").alias("source_type"), "content")
    video = ingest.transcripts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select(F.lit("youtube").alias("source_type"), "content")
    both = ingest.all_sources(web, crawl, video)
    return both.groupBy("source_type").agg(F.count("*").alias("n_sources"), F.sum(F.length("content")).alias("n_chars"))


@query
def src_nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("doc_id") % 10 == 0, F.lit(" \t 　\n")).otherwise(F.col("text"))
    sources = documents(spark, sf_dir).select("slug", blank.alias("content"))
    return sources.groupBy("slug").agg(F.count("*").alias("source_count"), F.count_if(~X.is_blank(F.col("content"))).alias("indexed_count"))


@query
def src_metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = as_sources(documents(spark, sf_dir))
    given = F.map_concat("metadata", F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("title"), F.lit("given"))).otherwise(F.create_map().cast(MAP)))
    merged = docs.select("doc_id", ingest.merged_metadata(F.col("url"), F.col("title"), F.col("source_type"), given).alias("m"))
    return merged.select("doc_id", *(F.col("m")[k].alias(k) for k in ("url", "title", "source_type", "score")), F.size("m").alias("n_keys"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chunks(documents(spark, sf_dir))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_of(_chunks(spark, sf_dir))


@query
def idx_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_id", "n_tokens", F.md5("text").alias("text_md5"))


@query
def idx_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("slug").agg(F.count_if(F.col("chunk_id") == 0).alias("n_documents"), F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most_tokens"))


@query
def idx_implicit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.implicit_paths(_chunks(spark, sf_dir)).select("src", "rel", "dst")


@query
def idx_paths_capped15(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = graph.extracted_paths(_chunks(spark, sf_dir))
    return paths.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n_paths"), F.count_distinct("src", "dst").alias("n_pairs"), F.min("src").alias("least_src"), F.max("dst").alias("most_dst"))


@query
def idx_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(_paths(spark, sf_dir))


@query
def idx_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relations(_paths(spark, sf_dir))


@query
def idx_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    without = messages(spark, sf_dir).select("slug")
    return graph.graph_stats(documents(spark, sf_dir).select("slug").union(without), _paths(spark, sf_dir))


@query
def graph_star_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "region", "customer", "orders"))
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    edges = [
        nation.join(region, nation.n_regionkey == region.r_regionkey).select(name("nation", "n_nationkey").alias("src"), F.lit("IN_REGION").alias("rel"), name("region", "r_regionkey").alias("dst")),
        customer.select(name("customer", "c_custkey").alias("src"), F.lit("IN_NATION").alias("rel"), name("nation", "c_nationkey").alias("dst")),
        orders.select(name("customer", "o_custkey").alias("src"), F.lit("PLACED").alias("rel"), name("order", "o_orderkey").alias("dst")),
    ]
    paths = ingest.all_sources(*edges).withColumn("slug", F.col("rel"))
    return graph.graph_stats(paths, paths)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("embedding is not null").withColumn("namespace", F.concat(F.lit("ns-"), F.col("label").cast("string")))


def _hits(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return retrieval.top_k(vectors.where("vec_id % 20 = 0"), vectors, by=by)


@query
def vec_cosine_topk5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


@query
def vec_namespace_topk5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, ["namespace"]).select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


@query
def vec_norm_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _vectors(spark, sf_dir).select("namespace", F.size("embedding").alias("width"), V.norm(F.col("embedding")).alias("norm"))
    return own.groupBy("namespace").agg(F.count("*").alias("n"), F.min("width").alias("least_width"), F.max("width").alias("most_width"), F.round(F.min("norm"), 4).alias("least_norm"), F.round(F.max("norm"), 4).alias("most_norm"))


def _rebuild(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _vectors(spark, sf_dir).select("namespace", "vec_id", "label")
    return rows.where("vec_id % 2 = 0"), rows.where("label < 5")


@query
def vec_rebuild_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, again = _rebuild(spark, sf_dir)
    return built.union(again).groupBy("namespace").agg(F.count("*").alias("n_rows"), F.sum("vec_id").alias("sum_ids"))


@query
def vec_rebuild_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, again = _rebuild(spark, sf_dir)
    kept = built.join(again.select("namespace").distinct(), "namespace", "left_anti")
    return kept.unionByName(again).groupBy("namespace").agg(F.count("*").alias("n_rows"), F.sum("vec_id").alias("sum_ids"))


def _hit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _chunks(spark, sf_dir).where("chunk_id = 0").select(F.col("doc_id").alias("vec_id"), "slug", "text")
    return _hits(spark, sf_dir).join(first, "vec_id")


@query
def vec_hits_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hit_texts(spark, sf_dir).select("query_id", "rank", "vec_id", "slug", F.md5("text").alias("text_md5"))


@query
def graph_expand_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _hit_texts(spark, sf_dir).select("query_id", "slug", graph.chunk_node(F.col("vec_id"), F.lit(0)).alias("node"))
    return graph.expand(seeds, graph.implicit_paths(_chunks(spark, sf_dir))).select("query_id", "slug", "rel", "node")


@query
def ctx_assemble_3000(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.assembled(_hit_texts(spark, sf_dir))
    return out.select("query_id", F.length("context").alias("n"), F.md5("context").alias("context_md5"))


@query
def chat_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is answered to each query from its context."""
    context = retrieval.assembled(_hit_texts(spark, sf_dir))
    asked = _vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("what is "), F.col("vec_id").cast("string")).alias("question"))
    answer = Providers().answer(F.coalesce("context", F.lit("")), F.col("question"))
    return asked.join(context, "query_id", "left").select("query_id", answer.alias("answer")).select("query_id", F.length("answer").alias("n"), F.md5("answer").alias("answer_md5"))


@query
def chat_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is answered to each query from all its hits' texts, in packs, and from the packs' answers."""
    asked = _vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("what is "), F.col("vec_id").cast("string")).alias("question"))
    out = retrieval.synthesised(_hit_texts(spark, sf_dir), asked, Providers().answer)
    return out.select("query_id", F.length("answer").alias("n"), F.md5("answer").alias("answer_md5"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("slug", F.concat(F.lit("expert-"), (F.col("conv_id") % 5).cast("string")))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.numbered(messages(spark, sf_dir))


def _flat(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")


@query
def chat_history20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.with_history(_numbered(spark, sf_dir)).select("slug", "seq", F.size("history").alias("n_history"), F.md5(_flat(F.col("history"))).alias("history_md5"))


@query
def chat_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.payload(chat.with_history(_numbered(spark, sf_dir)))
    return out.select("slug", "seq", F.size("messages").alias("n_messages"), F.md5(_flat(F.col("messages"))).alias("messages_md5"))


@query
def chat_history_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select("slug", "seq", "role", F.md5("text").alias("text_md5"))


@query
def chat_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.orphans(_numbered(spark, sf_dir)).select("slug", "seq")


@query
def chat_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = messages(spark, sf_dir)
    gone = own.where("conv_id % 10 = 2").select("slug")
    return chat.reset(own, gone).groupBy("slug").agg(F.count("*").alias("n_messages"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*(F.lit(x) for x in ("view", "pending", "signup", "building", "click", "building", "purchase", "ready", "error", "failed")))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("slug"), F.col("event_id").alias("version"), status[F.col("event_type")].alias("status"), F.col("ts").cast("timestamp").alias("created_at"), F.floor("value").alias("source_count"))


def experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = registry.latest(versions(spark, sf_dir))
    return own.select("*", F.concat(F.lit("Topic "), "slug").alias("topic"), F.concat(F.lit("Topic "), "slug", F.lit(" Expert")).alias("persona_name"), F.concat(F.lit("About "), "slug").alias("description"), (F.col("version") % 100).alias("node_count"), (F.col("version") % 1000).alias("relation_count"))


@query
def reg_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest(versions(spark, sf_dir)).select("slug", "version", "status", "source_count", "first_version")


@query
def reg_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.get(experts(spark, sf_dir), "u7").select("slug", "version", "status")


@query
def reg_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.listed(experts(spark, sf_dir)).select("slug", "first_version", "status")


@query
def reg_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.summary(experts(spark, sf_dir))


@query
def reg_gate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn") % 4
    kind = F.when(turn == 0, "chat").when(turn == 1, "course").when(turn == 2, "history").otherwise("create")
    message = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.lit(" \t\n")).otherwise(F.col("text"))
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), message.alias("message"), F.concat(F.lit("u"), (F.col("conv_id") * 3).cast("string")).alias("slug"))
    met = asked.join(experts(spark, sf_dir).select("slug", "status"), "slug", "left")
    return met.select("conv_id", "turn", "kind", registry.gate_code(F.col("kind"), F.col("status"), F.col("message")).alias("code"))


@query
def reg_create_shortcircuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = versions(spark, sf_dir)
    asked = own.select("slug").union(documents(spark, sf_dir).select("slug"))
    return registry.to_build(asked, registry.latest(own))


@query
def reg_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", X.slug(F.substring("text", 1, 80)).alias("topic_slug"))


@query
def prompt_desc_titles8(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = documents(spark, sf_dir).select("slug", "doc_id", first_line(F.col("text")).alias("title"))
    out = courses.title_prompt(ingest.top_ranked(own, "slug", courses.PROMPT_TITLES, "doc_id"))
    return out.select("slug", "n_titles", F.md5("bullets").alias("bullets_md5"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = experts(spark, sf_dir)
    kinds = F.explode(F.array(*map(F.lit, ("beginner", "intermediate", "advanced", "custom"))))
    asked = own.select("slug", kinds.alias("difficulty")).withColumn("focus", F.when(F.col("difficulty") == "custom", F.lit("history")).when(F.col("difficulty") == "beginner", F.lit("")))
    return courses.plan(own, asked)


@query
def course_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("slug", "difficulty", "n_modules", F.md5("prompt").alias("prompt_md5"))


@query
def course_modules_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return courses.modules(_plan(spark, sf_dir)).select("slug", "difficulty", "module_no", "module_title")


@query
def course_parse_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = courses.parsed(courses.rendered(_plan(spark, sf_dir)))
    m = F.col("course.modules")
    return out.select("slug", "difficulty", F.col("course.title").alias("title"), F.size(m).alias("n_modules"), F.array_join(F.transform(m, lambda x: x["title"]), ";").alias("module_titles"), F.array_join(F.transform(m, lambda x: F.size(x["key_concepts"]).cast("string")), ";").alias("concept_counts"), F.col("course.conclusion").alias("conclusion"))


@query
def course_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses streamed a paragraph at a time; custom ones break off at their third."""
    pieces = courses.deltas(courses.rendered(_plan(spark, sf_dir)), paragraphs)
    broken = pieces.withColumn("error", F.when((F.col("difficulty") == "custom") & (F.col("k") == 2), "broke off"))
    out = courses.plain_text(broken, ["slug", "difficulty"])
    return out.select("slug", "difficulty", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


@query
def ui_preview160(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", X.preview(given).alias("preview"))


def _framed(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", frames.frame(F.col("text"), mode).alias("raw"))


@query
def sse_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _framed(spark, sf_dir, "spec")
    return own.select("conv_id", "turn", F.length("raw").alias("n"), F.md5("raw").alias("raw_md5"))


@query
def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, legacy = (frames.parsed(_framed(spark, sf_dir, m), ["conv_id", "turn"]).withColumn("mode", F.lit(m)) for m in ("spec", "legacy"))
    return spec.unionByName(legacy).select("mode", "conv_id", "turn", "line_no", "kind", F.md5("data").alias("data_md5"))


@query
def ui_detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.details(experts(spark, sf_dir))


@query
def build_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.progress(experts(spark, sf_dir)).select("slug", "stage", "payload")


def _reply_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message as a reply sent line by line; those of the system break off at their second line."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("k", "delta"))
    deltas = told.withColumn("error", F.when((F.col("role") == "system") & (F.col("k") == 1), F.lit("broke off")))
    return frames.reply_frames(deltas, ["conv_id", "turn"])


@query
def sse_reply_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reply_frames(spark, sf_dir).select("conv_id", "turn", "frame_no", F.md5("raw").alias("raw_md5"))


@query
def sse_client_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = frames.parsed(_reply_frames(spark, sf_dir), ["conv_id", "turn", "frame_no"])
    out = frames.joined(lines, ["conv_id", "turn"], order="frame_no")
    return out.select("conv_id", "turn", F.md5("text").alias("text_md5"), "ended", "error")


@query
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.jobs import progress_stream

    return progress_stream(spark, f"{sf_dir}/events.parquet").select("slug", "stage", "n_frames", "n_chars")


@query
def stream_chat_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.jobs import chat_stream

    return chat_stream(spark, f"{sf_dir}/conversations.parquet")


@query
def stream_chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories kept as a stream's state; every eighth conversation begins by resetting its expert's."""
    from ..streaming.conversations import history_stream
    from ..streaming.jobs import input_stream

    rows = input_stream(spark, f"{sf_dir}/conversations.parquet")
    slug = F.concat(F.lit("expert-"), (F.col("conv_id") % 5).cast("string"))
    # Turns of a conversation stay far below the factor.
    seq = (F.col("conv_id") * 1_000_000 + F.col("turn")).cast("long")
    asked = rows.select(slug.alias("slug"), seq.alias("seq"), "role", F.col("text").alias("content"), ((F.col("conv_id") % 8 == 0) & (F.col("turn") == 0)).alias("reset"))
    return history_stream(spark, asked).select("slug", "seq", "n_history", "history_md5")


@query
def build_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experts of all documents built in two halves, the first of which fails before its vectors and is built again, taking over what was finished."""
    from ..sources.builds import Log
    from ..sources.store import Store
    from ..streaming.jobs import work_folder

    store = Store(spark, work_folder(spark, "build"))
    sources = as_sources(documents(spark, sf_dir))
    topics = sources.select(F.col("slug").alias("topic")).distinct()
    halves = [topics.where(F.crc32("topic") % 2 == k) for k in (0, 1)]
    none = sources.limit(0)

    def broken(text: Column) -> Column:
        raise RuntimeError("no service")

    def build(half: DataFrame, providers: Providers, resume: int | None = None) -> None:
        limit = spark.conf.get("quillspark.max_sources", None)
        spark.conf.set("quillspark.max_sources", str(2**31 - 1))
        try:
            flows.build_experts(store, half, sources.withColumn("slug", X.slug(F.col("slug"))), none.select("url", "title", "content"), none, providers, resume=resume)
        finally:
            spark.conf.unset("quillspark.max_sources") if limit is None else spark.conf.set("quillspark.max_sources", limit)

    try:
        build(halves[0], Providers(embed=broken))
    except RuntimeError:
        build(halves[0], Providers(), Log(store).begun()[-1])
    build(halves[1], Providers())
    count = lambda name, slug: store.read(name).groupBy(slug.alias("slug")).agg(F.count("*").alias(f"n_{name}"))
    own = registry.latest(store.read("expert_versions")).select("slug", "status", "source_count", "node_count", "relation_count")
    for name, slug in (*((t, F.col("slug")) for t in ("sources", "chunks", "nodes")), ("vectors", F.regexp_replace("namespace", "^expert-", ""))):
        own = own.join(count(name, slug), "slug", "left")
    return own.na.fill(0)
