"""Tables kept in the cluster's shared folder, and components of a graph of links."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors must share. Where it is unset and all is one process (tests), a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: its lineage ends here and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing still to be run reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.kept_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Up to so many keys (8 bytes each) go to every executor to pick rows before a shuffle.
BROADCAST_KEYS = 1_000_000


def meeting(rows: DataFrame, few: DataFrame, key: str, how: str = "inner", limit: int = BROADCAST_KEYS) -> DataFrame:
    """``rows`` joined with ``few`` on a long key, shuffling only the rows that have a partner.

    ``few`` must be cheap to read twice (a written table). Its distinct keys pick the
    rows first if there are at most ``limit`` of them, which is counted; beyond that,
    both sides are shuffled. ``how`` is inner, left_semi or left_anti.
    """
    keys = few.select(key).distinct()
    if few.count() > limit and keys.count() > limit:
        return rows.join(few, key, how)
    if how != "inner":
        return rows.join(F.broadcast(keys), key, how)
    return rows.join(F.broadcast(keys), key, "left_semi").join(few, key)


def components(links: DataFrame, nodes: str = "u v", what: str = "components") -> DataFrame:
    """(node, component): the least id that each linked node reaches, itself included.

    Alternates large-star and small-star steps, each of which keeps the components
    and the number of links, until nothing changes: a logarithmic number of rounds.
    Nodes without links are absent. The least neighbour is found by a partial
    aggregation and joined back, so that the links of a hot node are never gathered.
    """
    u, v = nodes.split()
    links = links.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).where("u <> v")
    links, before = written(links.distinct(), what), None
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        old, links = links, written(small, what)
        forget(old)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
