"""The expert registry as a log of versions; its life cycle and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

PENDING, BUILDING, READY, FAILED = "pending", "building", "ready", "failed"


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each slug, and the first version's number. One pass with partial aggregation."""
    rest = [c for c in versions.columns if c not in ("slug", "version")]
    picked = versions.groupBy("slug").agg(F.max(F.struct("version", *rest)).alias("l"), F.min("version").alias("first_version"))
    return picked.select("slug", "l.version", *(f"l.{c}" for c in rest), "first_version")


def present(experts: DataFrame) -> DataFrame:
    """Without entries that say nothing: one without a status counts as missing."""
    return experts.where("status is not null")


def get(experts: DataFrame, slug: str) -> DataFrame:
    return experts.where(F.col("slug") == slug)


def listed(experts: DataFrame) -> DataFrame:
    return experts.orderBy("first_version", "slug")


def summary(experts: DataFrame) -> DataFrame:
    """What an expert shows: neither its path nor its namespace."""
    return experts.select("slug", "topic", "persona_name", "description", "status", "source_count", "node_count", "relation_count", X.iso(F.col("created_at")).alias("created_at"))


def details(experts: DataFrame, prefix: str = "expert", base: str = "storage") -> DataFrame:
    """(slug, label, value): an expert's rows for display."""
    rows = {"Status": F.col("status"), "Sources": F.col("source_count"), "Concepts": F.col("node_count"), "Relations": F.col("relation_count"), "Namespace": F.concat(F.lit(prefix + "-"), "slug"), "Path": F.concat(F.lit(base + "/"), "slug")}
    shown = F.array(*(F.struct(F.lit(k).alias("label"), v.cast("string").alias("value")) for k, v in rows.items()))
    return experts.select("slug", F.explode(shown).alias("r")).select("slug", "r.label", "r.value")


def new_expert(topics: DataFrame, prefix: str = "expert", base: str = "storage") -> DataFrame:
    """Topics as experts being built. A topic without letters or digits has no slug and is refused."""
    slug = X.slug(F.col("topic"))
    return topics.withColumn("slug", slug).where("slug is not null").select(
        "slug", "topic", F.concat("topic", F.lit(" Expert")).alias("persona_name"), F.lit("").alias("description"), F.lit(BUILDING).alias("status"),
        *(F.lit(0).cast("long").alias(c) for c in ("source_count", "node_count", "relation_count")), F.concat(F.lit(base + "/"), slug).alias("storage_path"), F.concat(F.lit(prefix + "-"), slug).alias("namespace"),
    )


def to_build(requests: DataFrame, experts: DataFrame) -> DataFrame:
    """Requested slugs with what becomes of them: skip if ready, else build or rebuild from scratch."""
    met = requests.select("slug").distinct().join(experts.select("slug", "status"), "slug", "left")
    return met.select("slug", F.when(F.col("status") == READY, "skip").when(F.col("status").isNull(), "build").otherwise("rebuild").alias("action"))


def finished(building: DataFrame, stats: DataFrame, sources: DataFrame) -> DataFrame:
    """Experts being built made ready, with the counts of their graph and of all their sources, indexed or not."""
    n = sources.groupBy("slug").agg(F.count("*").alias("n_sources"))
    return building.drop("status", "source_count", "node_count", "relation_count").join(stats, "slug", "left").join(n, "slug", "left").select("*", F.lit(READY).alias("status"), F.coalesce("n_sources", F.lit(0)).alias("source_count")).drop("n_sources")


def failed(building: DataFrame) -> DataFrame:
    return building.withColumn("status", F.lit(FAILED))


def gate_code(kind: Column, status: Column, message: Column) -> Column:
    """The answer's code; the first check that fails decides.

    chat: 404 unknown, 409 not ready, 400 blank message. course: 404, 409. history: 404.
    reset: always 200. create: 400 for a blank topic.
    """
    ready, blank = status == READY, X.is_blank(message)
    return (
        F.when(kind.isin("chat", "course", "history") & status.isNull(), 404)
        .when(kind.isin("chat", "course") & ~ready, 409)
        .when(kind.isin("chat", "create") & blank, 400)
        .otherwise(200)
    )
