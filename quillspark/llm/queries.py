"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import cross_tokenizer_alignment
from .clustering import centroid_clustering
from .embeddings import embedding_dedup
from .jaccard import jaccard_join
from .language import language_id
from .lines import line_dedup
from .nearest import approximate_nearest
from .packing import best_fit_packing
from .pieces import sentencepiece_encode
from .quality import quality_rules
from .secrets import secret_scan
from .substrings import substring_dedup
from .toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level() -> tuple[str, str]:
    """The byte-level vocabulary for many languages, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), keep_ids=False).drop("ids")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), multi=byte_level())


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).drop("clean_text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return approximate_nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering(table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer_alignment(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).documents


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_embedding_dedup,
        op3_language_id,
        op4_quality_rules,
        op5_secret_scan,
        op6_toxicity,
        op7_jaccard_join,
        op8_line_dedup,
        op9_best_fit_packing,
        op10_substring_dedup,
        op11_nearest_neighbours,
        op12_centroid_clustering,
        op13_tokenizer_alignment,
    )
}

def clustering_sql(rounds: int = 5) -> str:
    """Each round as two tables: every vector's least (distance, number), and the floored means; what has no vectors stays."""
    assigned = "select vec_id, any_value(v) as v, min({'d': d, 'k': k}) as own from (select vec_id, rid, x.v, k, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from x cross join %s c) group by vec_id, rid"
    parts = ["""x as materialized (select vec_id, row_number() over () as rid, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0)""",
        "c0 as materialized (select row_number() over (order by sha256('2:' || vec_id), v) - 1 as k, v from x where vec_id is not null order by sha256('2:' || vec_id), v limit 40)"]
    for i in range(rounds):
        parts.append(f"a{i} as materialized ({assigned % f'c{i}'})")
        parts.append(f"""m{i} as (select k, list(m order by dim) as v from (select own.k as k, dim, sum(e) as s, count(*) as n, (s - ((s % n) + n) % n) // n as m from (select own, unnest(v) as e, unnest(range(64)) as dim from a{i}) group by all) group by k)""")
        parts.append(f"c{i + 1} as materialized (select c.k, coalesce(m.v, c.v)::bigint[] as v from c{i} c left join m{i} m on m.k = c.k)")
    parts.append(f"last as materialized ({assigned % f'c{rounds}'})")
    return f"""with {", ".join(parts)}
select vec_id, own.k::int as cluster, own.d as distance, (sum(own.d) over (partition by own.k))::bigint as cluster_inertia, (sum(own.d) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from last join c{rounds} c on c.k = own.k"""


#: SQL for those that it can express in the time that a check has; the others are held against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": """with recursive v as (select vec_id, label, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) >= 0.98 * a.norm * b.norm),
reached(a, b) as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a),
n as (select a, count(*) as n from links group by a), c as (select a, min(b) as b from reached group by a)
select vec_id, coalesce(n.n, 0) as n_links, least(vec_id, coalesce(c.b, vec_id)) as component_id, vec_id = least(vec_id, coalesce(c.b, vec_id)) as kept from embeddings left join n on n.a = vec_id left join c on c.a = vec_id""",
    "op7_jaccard_join": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as shingle from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
reached(a, b) as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a), c as (select a, min(b) as b from reached group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) as component_id from documents d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id""",
    "op10_substring_dedup": r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)),
firsts as (select h, min(doc_id) as first from windows group by h),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from windows join firsts using (h) where first < doc_id),
every as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n from every anti join gone using (doc_id, p) group by doc_id)
select w.doc_id, len(w.w) as n_words, len(w.w) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.kept, '')) as kept_sha256 from w left join kept using (doc_id)""",
    "op12_centroid_clustering": clustering_sql(),
}
