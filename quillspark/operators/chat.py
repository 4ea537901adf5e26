"""Conversations: numbering, the history window, payloads, orphans, reset.

One expert may hold a third of all messages, so nothing here sorts an expert's messages in
one task: numbers come from counts per conversation, summed in blocks of conversations,
and windows run over blocks of numbers that bring the rows before them along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 20
BLOCK = 512


def numbered(messages: DataFrame, conversations_per_block: int = 10_000, turns_per_part: int = 10_000) -> DataFrame:
    """Messages (slug, conv_id, turn, role, text) with ``seq``, their number within the slug by (conv_id, turn), from 1."""
    messages = messages.withColumn("part", F.floor(F.col("turn") / turns_per_part))
    counts = messages.groupBy("slug", "conv_id", "part").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("conv_id") / conversations_per_block))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("slug", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("slug", "block", before(Window.partitionBy("slug").orderBy("block")).alias("block_start"))
    starts = counts.withColumn("start", before(Window.partitionBy("slug", "block").orderBy("conv_id", "part"))).join(blocks, ["slug", "block"])
    starts = starts.select("slug", "conv_id", "part", (F.col("start") + F.col("block_start")).alias("start"))
    turn = F.row_number().over(Window.partitionBy("slug", "conv_id", "part").orderBy("turn"))
    return messages.withColumn("turn_no", turn).join(starts, ["slug", "conv_id", "part"]).withColumn("seq", (F.col("start") + F.col("turn_no")).cast("long")).drop("start", "turn_no", "part")


def with_history(messages: DataFrame, most: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """Numbered messages with ``history``: up to ``most`` (role, content) right before each, in order."""
    own = F.floor((F.col("seq") - 1) / block)
    twice = F.when((F.col("seq") - 1) % block >= block - most, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = messages.withColumn("block", F.explode(twice))
    w = Window.partitionBy("slug", "block").orderBy("seq").rowsBetween(-most, -1)
    history = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w)
    return dealt.withColumn("history", history).where(F.col("block") == own).drop("block")


def payload(messages: DataFrame) -> DataFrame:
    """The messages that go to a model for each user turn: its history, then itself."""
    own = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    return messages.where("role = 'user'").withColumn("messages", F.concat("history", own))


def orphans(messages: DataFrame) -> DataFrame:
    """User turns that no assistant answered: a failed reply leaves them behind."""
    after = messages.select("slug", (F.col("seq") - 1).alias("seq"), F.col("role").alias("next_role"))
    return messages.where("role = 'user'").join(after, ["slug", "seq"], "left").where("next_role is null or next_role <> 'assistant'")


def reset(messages: DataFrame, slugs: DataFrame) -> DataFrame:
    """Without the conversations of ``slugs``; resetting one that isn't there changes nothing."""
    return messages.join(slugs.select("slug").distinct(), "slug", "left_anti")


def appended(messages: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (slug, role, text, k: order among the new) numbered after each slug's last message."""
    last = messages.groupBy("slug").agg(F.max("seq").alias("last"))
    return new.join(last, "slug", "left").withColumn("seq", (F.coalesce("last", F.lit(0)) + F.col("k")).cast("long")).drop("last", "k")


def reply(deltas: DataFrame, by: tuple[str, ...] = ("slug",)) -> DataFrame:
    """A reply's pieces joined in order; one that failed leaves no message."""
    whole = deltas.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "delta"))), lambda d: d["delta"]), "").alias("text"), F.max(F.col("failed").cast("int")).alias("failed"))
    return whole.where("failed = 0").select(*by, F.lit("assistant").alias("role"), "text")
