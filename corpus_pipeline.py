"""The corpus pipeline: quality rules, line dedup, near-duplicate join, secret redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of the one before it, and its
decisions take effect; all but the last return the columns of ``documents``.

In every stage: columns besides those of ``documents`` are dropped, whatever their names; texts of any length
are read whole; an empty table gives an empty result; rows that repeat an id are one document, and go or
stay together. What each makes of nulls, empty texts and ties it says itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.jaccard import jaccard_join
from quillspark.llm.lines import line_dedup
from quillspark.llm.packing import best_fit_packing
from quillspark.llm.quality import quality_rules
from quillspark.llm.queries import byte_level, vocabulary
from quillspark.llm.secrets import secret_scan
from quillspark.llm.shared import forget, meeting, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose doc_id is not in ``gone``."""
    return meeting(docs, written(gone.select("doc_id").distinct(), "gone"), "doc_id", how="left_anti").select(COLUMNS)


def rewritten(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and empty texts among them; a measure on a bound is inside it. Rows without an id stay, as no verdict names them."""
    return without(docs, quality_rules(docs, vocabulary("piece_bpe_32k.model"), multi=byte_level()).where("not kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly, go; every document stays. Of ties the line first by (id, place) stays. Null texts
    stay null, blank lines and rows without an id as they are."""
    return rewritten(line_dedup(docs, carry=("lang", "source")), "kept_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays; a similarity of the threshold itself is near. Null texts, texts
    without words and rows without an id are near to nothing, and stay."""
    return without(docs, jaccard_join(docs).where("component_id <> doc_id"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, overlapping ones by one; every document stays, rows without an id too. Null texts stay null, empty ones empty."""
    return rewritten(secret_scan(docs, carry=("lang", "source")), "clean_text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences. Null and empty texts are one id; rows without an id are packed too. Ties go
    to the lower id."""
    return best_fit_packing(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("best-fit packing", packing)]

#: Tokenisation and packing can't be said in SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        if before is not None:  # nothing reads the stage before any longer
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
