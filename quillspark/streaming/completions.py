"""Completions as a stream of deltas, and courses written as they come.

``register(spark)`` makes the format ``quill_completion`` known to ``spark.readStream.format``. Each request (id, system_prompt, messages) is a
completion that a service writes; its deltas are numbered, and what is read of it so far is the stream's offset, so that a query that stops goes on where it
was and gives each delta once. Options: ``requests`` (a JSON list), ``model``, ``max_tokens``, and ``endpoint`` or ``client``.

A service starts a completion when it is first asked about it. GET with ``id`` (and, the first time, the request as JSON in ``request``, with
model and max_tokens) tells ``{"available": n, "ended": bool}``; with ``from`` and ``to`` also ``deltas``, a list of
``{"delta": text}`` or, as the last one, ``{"error": what}``. A ``client`` is a function (``module:function``) that takes the request with
those names and gives the same object.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..operators import courses, registry
from ..providers import scripted
from ..settings import settings
from ..sources.services import named
from ..sources.store import Store

SCHEMA = "request_id string, k int, delta string, error string"
#: Completions that are asked about at once, and those of one task.
ASKED_AT_ONCE, PER_TASK = 16, 1


@dataclass
class Deltas(InputPartition):
    """A range of each of some completions' deltas."""

    ranges: list[tuple[str, int, int]]


class CompletionReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        self.endpoint, self.client, self.timeout = given.get("endpoint", ""), given.get("client", ""), float(given.get("timeout", "60"))
        if bool(self.endpoint) == bool(self.client):
            raise ValueError("completions have either an endpoint or a client")
        limits = {"model": given.get("model"), "max_tokens": int(given.get("max_tokens", settings_default("max_tokens")))}
        self.requests = {r["id"]: {**r, **{k: v for k, v in limits.items() if v is not None and k not in r}} for r in json.loads(given.get("requests", "[]"))}

    def asked(self, request: dict, **more) -> dict:
        if self.client:
            return named(self.client)({**request, **more})
        query = {"id": request["id"], "request": json.dumps(request)} | more
        with urllib.request.urlopen(f"{self.endpoint}?{urllib.parse.urlencode(query)}", timeout=self.timeout) as answer:  # noqa: S310
            return json.loads(answer.read())

    def _available(self, request: dict) -> int:
        # A delta has a token at least, so a service that passes the limit isn't followed beyond it; one more place is for an error.
        return min(int(self.asked(request)["available"]), request["max_tokens"] + 1)

    def initialOffset(self) -> dict:
        return {name: 0 for name in self.requests}

    def latestOffset(self) -> dict:
        with ThreadPoolExecutor(ASKED_AT_ONCE) as pool:
            return dict(zip(self.requests, pool.map(self._available, self.requests.values()), strict=True))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = [(name, start.get(name, 0), n) for name, n in end.items() if n > start.get(name, 0)]
        return [Deltas(new[a : a + PER_TASK]) for a in range(0, len(new), PER_TASK)]

    def read(self, partition: Deltas) -> Iterator[tuple]:
        for name, start, end in partition.ranges:
            told = self.asked(self.requests[name], **{"from": start, "to": end})["deltas"]
            if len(told) != end - start:
                raise ValueError(f"completion {name} has {len(told)} deltas from {start} to {end}")
            for k, d in enumerate(told, start):
                yield (name, k, d.get("delta"), d.get("error"))

    def commit(self, end: dict) -> None:
        pass


def settings_default(name: str) -> str:
    from ..settings import Settings

    return str(getattr(Settings(), name))


class CompletionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quill_completion"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return CompletionReader(dict(self.options))


def offline(request: dict) -> dict:
    """The offline writer as a service: what the last message asks for (its text, a word at a time), all of it there at once."""
    words = scripted(request["messages"][-1]["content"], request["max_tokens"])
    return {"available": len(words), "ended": True, "deltas": [{"delta": w} for w in words[request.get("from", 0) : request.get("to", len(words))]]}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CompletionSource)


def completions(spark: SparkSession, requests: list[dict], **options: str) -> DataFrame:
    """The stream of all deltas of some requests."""
    register(spark)
    return spark.readStream.format("quill_completion").option("requests", json.dumps(requests)).options(**options).load()


class CourseWriter:
    """Courses asked for by (slug, difficulty, focus), written into table ``course_text`` as their deltas come.

    ``folder`` keeps the offsets: a writer that was stopped and is made again with the same folder and the same requests goes on. A batch that
    is written again replaces itself. What the gate refuses isn't asked for. The prompts, one for each course, pass through the driver, as a request is an option.
    """

    def __init__(self, store: Store, requests: DataFrame, folder: str, **options: str):
        self.store, self.folder, self.run = store, folder, folder.rstrip("/").rsplit("/", 1)[-1]
        self.options = options or {"client": "quillspark.streaming.completions:offline"}
        experts = registry.present(registry.latest(store.read("expert_versions")))
        asked = requests.select("slug", "difficulty", "focus").join(experts.select("slug", "status"), "slug", "left")
        self.asked = asked.withColumn("code", registry.gate_code(F.lit("course"), F.col("status"), F.lit(""))).drop("status")
        plans = courses.rendered(courses.plan(experts, self.asked.where("code = 200").select("slug", "difficulty", "focus")))
        system = courses.persona_prompt(F.col("topic"), F.lit(""))
        # The offline writer is given the text that it is to write; a model, the prompt.
        content = "markdown" if self.options.get("client", "").endswith(":offline") else "prompt"
        rows = plans.select("slug", "difficulty", system.alias("system"), F.col(content).alias("content")).orderBy("slug", "difficulty").collect()
        self.requests = [{"id": json.dumps([r.slug, r.difficulty]), "system_prompt": r.system, "messages": [{"role": "user", "content": r.content}]} for r in rows]

    def _keep(self, batch: DataFrame, number: int) -> None:
        name = F.from_json("request_id", "array<string>")
        rows = batch.select(name[0].alias("slug"), name[1].alias("difficulty"), "k", "delta", "error", F.lit(f"{self.run}-{number}").alias("batch"))
        self.store.replace("course_text", rows)

    def write(self, every: str | None = None):
        """Start writing: what there is by now, or, with an interval (such as ``1 second``), until stopped. Gives the query."""
        trigger = {"processingTime": every} if every else {"availableNow": True}
        stream = completions(self.store.spark, self.requests, **self.options)
        return stream.writeStream.foreachBatch(self._keep).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**trigger).start()

    def write_all(self, seconds: float = 600.0, every: float = 1.0) -> None:
        """Write until every course has ended, or the time is over."""
        reader, until = CompletionReader({"requests": json.dumps(self.requests), **self.options}), time.time() + seconds
        while True:
            ended = all(reader.asked(r)["ended"] for r in reader.requests.values())
            self.write().awaitTermination()
            if ended or time.time() > until:
                return
            time.sleep(every)

    def text(self) -> DataFrame:
        """(slug, difficulty, code, text) as far as it is written; what went wrong stands at the end of a course that broke off."""
        own = self.store.read("course_text").where(F.col("batch").startswith(f"{self.run}-"))
        return self.asked.select("slug", "difficulty", "code").join(courses.plain_text(own, ["slug", "difficulty"]), ["slug", "difficulty"], "left")
