"""Progress frames and conversation state as streams that run until their input is used up.

Each job keeps its checkpoint and its output in a new folder under spark.checkpoint.dir, so
a run that is repeated with the same folder goes on where it stopped.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chat import HISTORY
from ..operators.frames import frame

#: Stages of a build and the event that stands for each. Fixed values.
STAGES = {"view": 1, "signup": 2, "click": 3, "purchase": 4, "error": 5}


def work_folder(spark: SparkSession, what: str) -> str:
    """A folder that the driver and all executors share; a temporary one only where all is one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared}/{what}-{uuid.uuid4().hex}"


def input_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files under a path, or the one file there; a stream takes a single file only as a pattern."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def progress_frames(events: DataFrame) -> DataFrame:
    """(slug, seq, stage, payload): a frame for each event, in the order of ``seq`` within a slug."""
    stage = F.try_element_at(F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair)), F.col("event_type"))
    text = F.concat(stage.cast("string"), F.lit(f"/{len(STAGES)} "), F.col("event_type"))
    slug = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return events.where(stage.isNotNull()).select(slug.alias("slug"), F.col("event_id").alias("seq"), stage.alias("stage"), frame(text).alias("payload"))


def progress_stream(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Frames written as they come; then, of what was written, the frames and characters by slug and stage."""
    folder = folder or work_folder(spark, "progress")
    out = progress_frames(input_stream(spark, path)).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    out.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.groupBy("slug", "stage").agg(F.count("*").alias("n_frames"), F.sum(F.length("payload")).alias("n_chars"))


def _digest(messages: list[list[str]]) -> str:
    return hashlib.md5("|".join(f"{role}:{text}" for role, text in messages).encode()).hexdigest()


def remember(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep a conversation's last messages. What is held for one conversation is bounded by HISTORY."""
    n, roles, texts = state.get if state.exists else (0, [], [])
    new = pd.DataFrame({"turn": [], "role": [], "text": []})
    for part in parts:
        n += len(part)
        new = pd.concat([new, part[["turn", "role", "text"]]]).nlargest(HISTORY, "turn")
    new = new.sort_values("turn")
    roles, texts = (list(old) + new[c].tolist() for old, c in ((roles, "role"), (texts, "text")))
    roles, texts = roles[-HISTORY:], texts[-HISTORY:]
    state.update((n, roles, texts))
    yield pd.DataFrame({"conv_id": [key[0]], "n_messages": [n], "n_history": [len(roles)], "last_role": [roles[-1]], "history_md5": [_digest(list(zip(roles, texts, strict=True)))]})


def chat_stream(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """(conv_id, n_messages, n_history, last_role, history_md5) after the last batch. A batch brings turns after those before it."""
    folder = folder or work_folder(spark, "chat")
    schema = "conv_id long, n_messages long, n_history int, last_role string, history_md5 string"
    rows = input_stream(spark, path).groupBy("conv_id").applyInPandasWithState(remember, schema, "n long, roles array<string>, texts array<string>", "update", GroupStateTimeout.NoTimeout)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    rows.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    own = spark.read.schema(schema + ", batch long").parquet(f"{folder}/rows")
    last = own.groupBy("conv_id").agg(F.max(F.struct("batch", "n_messages", "n_history", "last_role", "history_md5")).alias("l"))
    return last.select("conv_id", "l.n_messages", "l.n_history", "l.last_role", "l.history_md5")
