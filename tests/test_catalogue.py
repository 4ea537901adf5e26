"""Every catalogue query against its SQL on the smallest tables, and the plans of those that matter at scale."""

from __future__ import annotations

import duckdb
import pytest

from compare import connect, differences
from quillspark.plans import catalogue, oracle

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(oracle.SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equal(spark, con, name):
    assert differences(catalogue.QUERIES[name](spark, SF_DIR), con, oracle.SQL[name]) == ""


def test_restarted_builds_have_a_vector_of_each_chunk(spark, tmp_path):
    """Of short texts too, whose words' hashes cancel each other; sources may begin as namespaces do."""
    rows = [(0, "sand salt", "src0"), (1, "They stones", "src1"), (2, "sand salt they stones", "expert-a"), (3, "sand salt sand", "src0"), (4, " \n", "src1"), (5, "x " * 600, "expert-a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.build_restart(spark, str(tmp_path))
    assert differences(got, con, oracle.SQL["build_restart"]) == ""
    assert {(r.slug, r.n_sources, r.n_vectors) for r in got.collect()} == {("src0", 2, 2), ("src1", 2, 1), ("expert-a", 2, 3)}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_limit_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(catalogue.src_topn_per_expert(spark, SF_DIR))


def test_only_read_what_is_needed(spark):
    told = plan(catalogue.chat_reset(spark, SF_DIR))
    assert "ReadSchema: struct<conv_id:bigint>" in told
    assert "Python" not in plan(catalogue.idx_relations(spark, SF_DIR))


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "slug", "system_prompt", "messages"]
    assert out.count() > 0


def test_entry_asks_with_the_whole_text(spark):
    import __spark_entry__

    asked = catalogue.documents(spark, SF_DIR).where("doc_id % 20 = 0 and length(text) > 200").selectExpr("doc_id query_id", "text")
    got = __spark_entry__.entry(spark).join(asked, "query_id")
    assert got.where("element_at(messages, -1).content = text").count() == got.count() > 0
