"""Source documents as DataFrames: (slug, rank, url, title, content, source_type, metadata).

Readers of remote services are providers; everything around them is here. A provider
that fails either ends the build ("fail", web search) or gives nothing ("skip", all
others).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X

SOURCE_COLUMNS = ["slug", "rank", "url", "title", "content", "source_type", "metadata"]
WEB_CHARS, CRAWL_CHARS, FILE_CHARS = 12_000, 15_000, 20_000
LEAST_CHARS, LEAST_FILE_CHARS = 100, 50
MAX_SOURCES, ENRICHED, PAPERS = 20, 5, 5


class SourceError(RuntimeError):
    """A source whose failure ends the build."""


def read_source(read: Callable[[], DataFrame], empty: DataFrame, on_error: str = "fail") -> DataFrame:
    """What ``read`` gives; if it fails, an error or the empty table, as ``on_error`` says."""
    try:
        return read()
    except Exception as e:
        if on_error == "fail":
            raise SourceError(str(e)) from e
        return empty.limit(0)


def long_enough(rows: DataFrame, content: str, least: int = LEAST_CHARS) -> DataFrame:
    """Rows whose content has ``least`` characters without the white space around it. The cheap bound goes first."""
    return rows.where(F.length(content) >= least).where(X.stripped_length(F.col(content)) >= least)


def ranked(rows: DataFrame, by: str, *order: Column | str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def top_ranked(rows: DataFrame, by: str, most: int, *order: Column | str) -> DataFrame:
    """The first rows of each group; each task cuts its groups before the shuffle."""
    return ranked(rows, by, *order).where(F.col("rank") <= most)


def web_sources(hits: DataFrame) -> DataFrame:
    """Search hits (slug, rank, url, title, text, metadata): long enough ones, cut, with a title."""
    kept = long_enough(hits, "text")
    return kept.select("slug", "rank", "url", X.or_else(F.col("title"), F.col("url")).alias("title"), X.cut(F.col("text"), WEB_CHARS).alias("content"), F.lit("web").alias("source_type"), "metadata")


def crawled(pages: DataFrame) -> DataFrame:
    """Pages (url, html) as content; the url is a title only where the page has none at all."""
    title = F.when(F.col("html").rlike(H.TITLE), H.title(F.col("html"))).otherwise(F.col("url"))
    # The generator keeps the filter on the content from computing it once more.
    read = pages.select(*(c for c in pages.columns if c != "html"), title.alias("title"), F.explode(F.array(H.main_text(F.col("html")))).alias("content"))
    return long_enough(read, "content").withColumn("content", X.cut(F.col("content"), CRAWL_CHARS))


def enriched(sources: DataFrame, crawls: DataFrame, key: str = "url", first: int = ENRICHED) -> DataFrame:
    """The first sources of each expert replaced whole by their crawl, where there is one.

    A crawl drops the metadata it replaces. Ranks stay. ``crawls`` has the key, url,
    title and content, once for each key.
    """
    own = F.struct("url", "title", "content", "source_type", "metadata")
    new = F.struct("url", "title", "content", F.lit("crawl").alias("source_type"), F.create_map().cast("map<string,string>").alias("metadata"))
    few = sources.where(F.col("rank") <= first)
    met = few.select("slug", "rank", F.col(key).alias("key"), own.alias("own")).join(crawls.select(F.col(key).alias("key"), new.alias("new")), "key", "left")
    met = met.select("slug", "rank", F.when(F.col("new").isNotNull(), F.col("new")).otherwise(F.col("own")).alias("s")).select("slug", "rank", "s.*")
    return met.unionByName(sources.where(F.col("rank") > first).select(met.columns))


def paper(title: Column, authors: Column, abstract: Column, published: Column) -> Column:
    return F.concat(F.lit("## "), title, F.lit("\n\nBy: "), F.array_join(authors, ", "), F.lit("\n\n"), abstract, F.lit("\n\nDate: "), published)


def transcripts(segments: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Segments joined by spaces in order; long enough ones, cut.

    Only segments that the cut, or the least length, can reach are gathered, so that a long one's rest isn't.
    """
    w = Window.partitionBy(by).orderBy(order, text).rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda length: F.coalesce(F.sum(length).over(w), F.lit(0))
    solid = F.length(F.regexp_replace(text, X.SPACES, ""))
    segments = segments.select(by, order, text, sofar(F.length(text) + 1).alias("before"), sofar(solid).alias("solid_before")).where((F.col("before") <= CRAWL_CHARS) | (F.col("solid_before") < LEAST_CHARS))
    joined = segments.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), " ").alias("content"))
    return long_enough(joined, "content").withColumn("content", X.cut(F.col("content"), CRAWL_CHARS))


def file_text(elements: Column) -> Column:
    """Non-blank elements joined by empty lines; null if too short."""
    joined = F.array_join(F.filter(elements, lambda e: ~X.is_blank(e)), "\n\n")
    return F.when(X.stripped_length(joined) >= LEAST_FILE_CHARS, X.cut(joined, FILE_CHARS))


def merged_metadata(url: Column, title: Column, source_type: Column, provider: Column) -> Column:
    """The base keys and the provider's, which win."""
    base = F.create_map(F.lit("url"), url, F.lit("title"), title, F.lit("source_type"), source_type)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(provider, k)), provider)


def all_sources(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def indexable(sources: DataFrame, content: str = "content") -> DataFrame:
    return sources.where(~X.is_blank(F.col(content)))
