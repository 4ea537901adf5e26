"""Language identification by Bayesian fusion of evidence.

Four sources speak about a page: its text (naive Bayes over hashed byte trigrams), the
language its markup declares, the suffix of its address, and its host. How far to trust
a declaration, and what a suffix and a host usually hold, is counted over all pages by
grouped aggregation, in shares of the text's own verdict. Hosts are smoothed towards their
suffix, and suffixes towards all pages, so a host with few pages says little. A page's
own share is taken out of the counts before they judge it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .words import sliced

CELLS = 1 << 14
#: Trigrams of one text count as at most so many independent ones.
EVIDENCE = 150.0
#: Pages scored at once; 8 * CELLS bytes each.
SCORED_ROWS = 128


def plain_text(html: Column) -> Column:
    """The text outside markup, scripts, styles and comments, in lower case."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    return F.lower(F.regexp_replace(text, r"&[#\w]{1,12};|[\s\d]+", " "))


def trigram_counts(raw: np.ndarray) -> np.ndarray:
    if len(raw) < 3:
        return np.zeros(CELLS)
    wide = raw.astype(np.uint32)
    code = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(18), minlength=CELLS).astype(float)


def _per_text(part: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    for text in part.column(column).to_pylist():
        yield trigram_counts(np.frombuffer((text or "").encode(), np.uint8))


def train(documents: DataFrame, *, max_rows: int = 1500) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each cell) of at most ``max_rows`` labelled rows of each language, picked by a hash of the id."""
    labelled = documents.where("lang is not null and text is not null").select("doc_id", "lang", F.lower(F.regexp_replace("text", r"[\s\d]+", " ")).alias("text"))
    of_each = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = labelled.where("doc_id is not null").select("doc_id", "lang").distinct().withColumn("rank", F.row_number().over(of_each)).where(F.col("rank") <= max_rows).drop("rank")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in sliced(batches, "text"):
            for lang, own in zip(part.column(1).to_pylist(), _per_text(part, 2), strict=True):
                # Each text counts alike, however long it is.
                total[lang] = total.get(lang, np.zeros(CELLS)) + own / max(1.0, own.sum()) * 1000
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k for k in total for _ in range(CELLS)]), pa.array(np.tile(np.arange(CELLS), len(total))), pa.array(np.concatenate(list(total.values())))], names=["lang", "cell", "n"])

    counted = labelled.join(F.broadcast(picked), ["doc_id", "lang"]).select("doc_id", "lang", "text").mapInArrow(count, "lang string, cell long, n double")
    rows = counted.where("n > 0").groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in rows})
    table = np.full((len(languages), CELLS), 0.5)
    for r in rows:
        table[languages.index(r.lang), r.cell] += r.n
    return languages, np.log(table / table.sum(1, keepdims=True))


def _log_softmax(values: list[Column]) -> list[Column]:
    most = F.greatest(*values)
    total = most + F.log(reduce(lambda a, b: a + b, [F.exp(v - most) for v in values]))
    return [v - total for v in values]


def _scored(table: np.ndarray):
    """Log likelihoods of pages (page_id, host, suffix, declared, text) by language. A page's counts are a dense row, so slices hold few rows as well as few bytes."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            for at, rows in enumerate(batched(_per_text(part, 4), SCORED_ROWS)):
                counts = np.stack(rows)
                n = counts.sum(1)
                ll = counts @ table.T * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
                own = part.slice(at * SCORED_ROWS, len(rows))
                yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array(n.astype(np.int64)), *(pa.array(ll[:, k]) for k in range(len(table)))], names=["page_id", "host", "suffix", "declared", "n_trigrams", *(f"l{k}" for k in range(len(table)))])

    return score


def language_id(pages: DataFrame, documents: DataFrame, *, host_weight: float = 5.0, suffix_weight: float = 20.0, declared_weight: float = 2.0, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", max_rows: int = 1500) -> DataFrame:
    """One row per page: page_id, lang, confidence, text_lang, declared, host, suffix, n_trigrams.

    ``documents`` has labelled texts (doc_id, text, lang). Null or empty pages have no
    text evidence and are judged by what else is known; a missing declaration or address
    is a value of its own. Ties go to the language first in order. With fewer than two
    languages in ``documents`` that language, or null, is every page's. Repeated rows are
    judged alike, rows without an id too. Pages of any length are read whole. Other columns, whatever their
    names, are not read. An empty table gives an empty result.
    """
    languages, table = train(documents, max_rows=max_rows)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]{2,3})\b""", 1))
    read = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"),
        declared.alias("declared"),
        F.coalesce(plain_text(F.col(html_col)), F.lit("")).alias("text"),
    )
    if len(languages) < 2:
        only = F.lit(languages[0] if languages else None).cast("string")
        return read.select("page_id", only.alias("lang"), F.lit(1.0).alias("confidence"), only.alias("text_lang"), "declared", "host", "suffix", F.lit(0).cast("long").alias("n_trigrams"))

    every = range(len(languages))
    schema = "page_id long, host string, suffix string, declared string, n_trigrams long" + "".join(f", l{k} double" for k in every)
    heard = read.mapInArrow(_scored(table), schema)
    heard = heard.select("page_id", "host", "suffix", "declared", "n_trigrams", *(x.alias(f"l{k}") for k, x in enumerate(_log_softmax([F.col(f"l{k}") for k in every]))))
    heard = written(heard.withColumns({f"p{k}": F.exp(f"l{k}") for k in every}), "text-evidence")

    def sums(keys: list[str], name: str) -> DataFrame:
        return heard.groupBy(*keys).agg(*(F.sum(f"p{k}").alias(f"{name}{k}") for k in every))

    # Languages are few: all pages together, suffixes and declarations are small tables; hosts are many.
    fused = heard.crossJoin(F.broadcast(sums([], "all"))).join(sums(["suffix"], "suffix_"), "suffix").join(sums(["host"], "host_"), "host").join(sums(["declared"], "said_"), "declared")
    n_all = reduce(lambda a, b: a + b, [F.col(f"all{k}") for k in every])
    share = [(F.col(f"all{k}") + 1) / (n_all + len(languages)) for k in every]

    def smoothed(name: str, towards: list[Column], weight: float) -> list[Column]:
        own = [F.greatest(F.lit(0.0), F.col(f"{name}{k}") - F.col(f"p{k}")) for k in every]
        total = reduce(lambda a, b: a + b, own)
        return [(own[k] + weight * towards[k]) / (total + weight) for k in every]

    by_host = smoothed("host_", smoothed("suffix_", share, suffix_weight), host_weight)
    # P(declaration | language) is, by Bayes, P(language | declaration) / P(language), up to a factor common to all languages.
    by_said = smoothed("said_", share, declared_weight)
    total = [F.col(f"l{k}") + F.log(by_host[k]) + F.log(by_said[k]) - F.log(share[k]) for k in every]
    fused = fused.select("page_id", "host", "suffix", "declared", "n_trigrams", F.array(*(F.col(f"l{k}") for k in every)).alias("text_says"), F.array(*_log_softmax(total)).alias("all_says"))
    names = F.array(*map(F.lit, languages))

    def best(values: str) -> Column:
        return F.get(names, (F.array_position(values, F.array_max(values)) - 1).cast("int"))

    return fused.select("page_id", best("all_says").alias("lang"), F.exp(F.array_max("all_says")).alias("confidence"), best("text_says").alias("text_lang"), "declared", "host", "suffix", "n_trigrams")
