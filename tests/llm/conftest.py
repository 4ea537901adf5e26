from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
#: Nulls, blanks, one word, ties, repeats and a long text, all at once.
TEXTS = [None, "", " \t\n", "one", "one", "a b c d", "A b C d", "same line of some length here\nsame line of some length here\nsame line of some length heré", "wörd ünd 日本 😀 " * 12, "x" * 5000, " ".join(f"w{i}" for i in range(3000)), "tail " + " ".join(f"w{i}" for i in range(100, 200))]


def clashing(df):
    """Extra columns with names that operators use inside."""
    return df.withColumns({c: F.lit("clash") for c in ("words", "n_words", "label", "key", "kept", "place", "component", "rep", "token", "at", "row", "ids", "u", "v", "first", "toxic_") if c not in df.columns})


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 0) for i, t in enumerate(TEXTS)] + [(3, "one", None, "s", 3), (None, "no id", "en", "s", 5)]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
