"""What a build starts from: searches, crawls of the first hits, and papers, asked for by topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import Settings, settings
from ..sources import ingest, services
from .flows import build_experts

#: A service by kind (web, crawl, papers): its options.
Services = dict[str, dict[str, str]]


def searched(topics: DataFrame, options: dict[str, str], said: Settings) -> DataFrame:
    """Source documents of what a search finds for each topic (slug, topic)."""
    found = services.fetch(topics, "web", "topic", limit=said.max_sources, **options)
    named = topics.withColumnRenamed("topic", "request").join(found, "request").drop("request")
    # Hits that are too short go before the ranks are counted: the next ones move up.
    kept = ingest.web_sources(named.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))).withColumnRenamed("rank", "hit")
    return ingest.ranked(kept, "slug", "hit").drop("hit").select(ingest.SOURCE_COLUMNS)


def crawled(sources: DataFrame, options: dict[str, str], said: Settings) -> DataFrame:
    """(url, title, content) of the pages behind each topic's first sources; those that can't be had are left out."""
    pages = services.fetch(sources.where(F.col("rank") <= said.crawls), "crawl", "url", **options)
    read = pages.select(F.col("request").alias("url"), F.coalesce(F.col("metadata")["title"], "title", "request").alias("title"), "content", "metadata")
    return ingest.long_enough(read, "content").withColumn("content", F.substring("content", 1, ingest.CRAWL_CHARS)).dropDuplicates(["url"])


def papers(topics: DataFrame, options: dict[str, str], said: Settings) -> DataFrame:
    """Source documents of the papers on each topic, in the service's order."""
    found = services.fetch(topics, "papers", "topic", limit=said.papers, **options)
    named = topics.withColumnRenamed("topic", "request").join(found, "request")
    text = lambda c: F.coalesce(c, F.lit(""))
    content = ingest.paper(text("title"), F.coalesce("authors", F.array().cast("array<string>")), text("abstract"), text("published"))
    about = F.map_filter(F.create_map(F.lit("authors"), F.array_join("authors", ", "), F.lit("published"), F.col("published"), F.lit("doi"), F.col("doi")), lambda _, v: v.isNotNull())
    return named.select("slug", "rank", "url", "title", content.alias("content"), F.lit("arxiv").alias("source_type"), about.alias("metadata"))


def transcripts(videos: DataFrame, options: dict[str, str]) -> DataFrame:
    """(url, video_id, title, content) of videos (url, title); those without an id, a transcript, or enough of one are left out."""
    from ..functions import text as X

    asked = videos.withColumn("video_id", X.video_id(F.col("url"))).where("video_id is not null")
    found = services.fetch(asked, "transcripts", "video_id", **options)
    joined = ingest.transcripts(found, "request", "rank", "text").withColumnRenamed("request", "video_id")
    return asked.join(joined, "video_id").select("url", "video_id", X.or_else(F.col("title"), F.concat(F.lit("YouTube: "), "video_id")).alias("title"), "content")


def research_and_build(store, topics: DataFrame, asked: Services, **building) -> DataFrame:
    """Build experts from what services say of their topics. The search ends the build if it fails; pages and papers that can't be had are left out.

    What was found is kept in the store before it is built from, as services may answer differently the next time. A service
    without options isn't asked. Ready experts aren't looked up again.
    """
    said, kept = settings(store.spark), store.scratch()

    def gathered(building: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        wanted = building.select("slug", "topic")
        found = kept("web", searched(wanted, asked["web"], said))
        none = found.limit(0)
        pages = kept("crawl", crawled(found, asked["crawl"], said)) if "crawl" in asked else none.select("url", "title", "content")
        return found, pages, kept("papers", papers(wanted, asked["papers"], said)) if "papers" in asked else none

    try:
        return build_experts(store, topics, gathered, **building)
    finally:
        kept.forget()
