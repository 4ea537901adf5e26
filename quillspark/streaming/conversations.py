"""Conversations as keyed state: the last messages of each, in a list that a message can reset and that ends by itself.

A stream of messages (slug, seq, role, content, reset) goes through a stateful processor. For each message comes its history: up to
``most`` messages right before it, in the order of ``seq``. ``reset`` empties a conversation before its message counts. One that is idle
for ``idle`` seconds is emptied by a timer. What is held for one conversation is ``most`` messages, whatever its length; a batch's
messages of one conversation are sorted in one task, so the files of a batch bound what that task holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.chat import HISTORY
from ..plans import flows
from ..providers import Providers
from ..sources.store import Store
from .jobs import work_folder

OUTPUT = "slug string, seq long, n_history int, history_md5 string, n_seen long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Conversation(StatefulProcessor):
    """Keeps the last messages of one conversation, and how many it has had since it was last empty."""

    def __init__(self, most: int = HISTORY, idle: float | None = None):
        self.most, self.idle = most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getListState("history", "seq long, role string, content string")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.history.get()] if self.history.exists() else []
        n = self.seen.get()[0] if self.seen.exists() else 0
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            if r.reset:
                held, n = [], 0
            told = "|".join(f"{role}:{content}" for _, role, content in held)
            n += 1
            out.append((key[0], r.seq, len(held), hashlib.md5(told.encode()).hexdigest(), n))
            held = [*held, (int(r.seq), r.role, r.content)][-self.most :]
        self.history.put(held)
        self.seen.update((n,))
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.history.clear()
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """Within, queries that start keep their state in RocksDB, which lists and timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def histories(messages: DataFrame, most: int = HISTORY, idle: float | None = None) -> DataFrame:
    """(slug, seq, n_history, history_md5, n_seen) of a stream of messages (slug, seq, role, content, reset). A batch brings messages after those before it."""
    asked = messages.select("slug", "seq", "role", "content", F.coalesce("reset", F.lit(False)).alias("reset"))
    return asked.groupBy("slug").transformWithStateInPandas(Conversation(most, idle), OUTPUT, "append", "processingTime" if idle is not None else "none")


def history_stream(spark: SparkSession, messages: DataFrame, folder: str | None = None, most: int = HISTORY, idle: float | None = None) -> DataFrame:
    """Run ``histories`` over what a stream has by now. The same folder goes on where the last run stopped; the result is of all runs.

    The file sink writes each batch's rows once, also where a batch is run again. With ``idle``, all there is by now is one batch: a query
    with timers has always another batch to run.
    """
    folder = folder or work_folder(spark, "histories")
    with rocks(spark):
        out = histories(messages, most, idle).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").trigger(**({"availableNow": True} if idle is None else {"once": True})).start()
        out.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{folder}/rows")


def held(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, seq, role, content): what a stream keeps of each conversation now, read from its state. A conversation that was emptied has no rows."""
    with rocks(spark):
        own = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", "history").load()
        return own.select("key.slug", "list_element.seq", "list_element.role", "list_element.content")


def turn_stream(store: Store, questions: DataFrame, folder: str, providers: Providers | None = None) -> None:
    """Answer a stream of questions (slug, seq, text) with what is there by now, each expert's in the order of ``seq``.

    Every batch is joined with the registry, the chunks and the vectors as they are then. Turns are stored under the batch's number, so a batch that is run
    again, after a failure between answers and the stream's own log, replaces what it stored: each question counts once. Where an expert is
    asked several times in a batch, the batch is worked off in rounds, as each answer is part of the next one's history.
    """
    name = folder.rstrip("/").rsplit("/", 1)[-1]

    def answer(batch: DataFrame, number: int) -> None:
        answer_batch(store, batch, f"{name}-{number}", providers)

    questions.writeStream.foreachBatch(answer).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def answer_batch(store: Store, batch: DataFrame, name: str, providers: Providers | None = None) -> None:
    """The turns of one batch (slug, seq, text), stored under ``name``."""
    scratch = store.scratch()
    try:
        asked = scratch("asked", batch.select("slug", "seq", "text").withColumn("round", F.row_number().over(Window.partitionBy("slug").orderBy("seq", "text"))))
        rounds = asked.agg(F.max("round")).first()[0] or 0
        # What an earlier run of this batch left of later rounds isn't history of the first.
        for k in range(1, rounds + 1):
            flows.forget_turn(store, f"{name}-{k}")
        for k in range(1, rounds + 1):
            flows.converse(store, asked.where(F.col("round") == k).select("slug", "text"), providers, turn=f"{name}-{k}").count()
    finally:
        scratch.forget()
