"""Server-sent event frames, made and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DONE, ERROR = "[DONE]", "[ERROR]"
#: What goes before an error told in the stream itself, by kind of stream. Fixed values.
ERRORS = {"chat": "[ERROR] ", "build": "ERROR: ", "course": "\n\n**Error:** "}


def frame(payload: Column, mode: str = "spec") -> Column:
    """One frame. ``spec`` gives each line of the payload its own prefix; ``legacy`` only the first, which loses the others on reading."""
    if mode == "legacy":
        return F.concat(F.lit("data: "), payload, F.lit("\n\n"))
    if mode != "spec":
        raise ValueError(f"mode must be spec or legacy, not {mode!r}")
    return F.concat(F.lit("data: "), F.array_join(F.split(payload, "\n"), "\ndata: "), F.lit("\n\n"))


def parsed(frames: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """The data lines of raw frames in order: (keys, line_no, data, kind: data, done or error)."""
    lines = frames.select(*keys, F.posexplode(F.split(raw, "\n")).alias("line_no", "line")).where(F.startswith("line", F.lit("data: ")))
    data = F.substring("line", 7, 2_147_483_647)
    kind = F.when(data == DONE, "done").when(F.startswith(data, F.lit(ERROR)), "error").otherwise("data")
    return lines.select(*keys, "line_no", data.alias("data"), kind.alias("kind"))


def reply_frames(deltas: DataFrame, keys: list[str], order: str = "k", text: str = "delta", error: str = "error") -> DataFrame:
    """(keys, frame_no, raw): a frame for each delta in order, then one that says done, or what went wrong.

    ``deltas`` has the keys, an order from 0 without gaps, a text, and an error that is
    null unless the reply broke off there; what follows an error isn't sent.
    """
    broken = deltas.where(F.col(error).isNotNull()).groupBy(*keys).agg(F.min(order).alias("stop"), F.min_by(error, order).alias("why"))
    size = deltas.groupBy(*keys).agg((F.max(order) + 1).alias("n"))
    ends = size.join(broken, keys, "left").select(*keys, F.coalesce("stop", "n").cast("int").alias("end"), F.when(F.col("why").isNotNull(), F.concat(F.lit(ERROR + " "), "why")).otherwise(DONE).alias("last"))
    sent = deltas.join(ends, keys).where(F.col(order) < F.col("end")).select(*keys, F.col(order).cast("int").alias("frame_no"), frame(F.col(text)).alias("raw"))
    return sent.unionByName(ends.select(*keys, F.col("end").alias("frame_no"), frame(F.col("last")).alias("raw")))


def joined(frames: DataFrame, keys: list[str], order: str = "line_no", data: str = "data") -> DataFrame:
    """What a client has gathered: a reply's data lines joined in order, and whether it ended well."""
    listed = frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "kind", data))).alias("l"))
    text = F.array_join(F.transform(F.filter("l", lambda x: x["kind"] == "data"), lambda x: x[data]), "")
    return listed.select(*keys, text.alias("text"), F.exists("l", lambda x: x["kind"] == "done").alias("ended"), F.get(F.transform(F.filter("l", lambda x: x["kind"] == "error"), lambda x: x[data]), F.lit(0)).alias("error"))


def progress(experts: DataFrame) -> DataFrame:
    """(slug, seq, stage, payload): what a build tells at each of its five stages, with its counts."""
    steps = [("sources", "source_count"), ("pages", "source_count"), ("papers", "source_count"), ("concepts", "node_count"), ("relations", "relation_count")]
    rows = F.array(*(F.struct(F.lit(k).alias("stage"), F.concat(F.lit(f"{k}/{len(steps)} {name}: "), F.col(c).cast("string")).alias("payload")) for k, (name, c) in enumerate(steps, 1)))
    return experts.select("slug", F.explode(rows).alias("r")).select("slug", F.col("r.stage").cast("long").alias("seq"), "r.stage", "r.payload")
