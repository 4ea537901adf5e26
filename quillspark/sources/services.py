"""Remote services as Spark data sources: web search, crawls, papers, transcripts.

``register(spark)`` makes the formats ``quill_web``, ``quill_crawl``, ``quill_papers`` and ``quill_transcripts`` known to ``spark.read.format``.
Each request (a topic, or an address) is an input partition of its own unless told otherwise, so requests run where there is room for them, and one that
fails is tried again or given up by itself. A search that fails ends the job; of the others a failing request gives nothing.

A service is asked by GET with ``q`` and ``limit`` and answers with a JSON list of objects, or is a Python function (option ``client``,
``module:function``) of the same arguments. Options: ``endpoint`` or ``client``; ``requests`` (a JSON list); ``limit``; ``suffix`` (put behind each
request); ``on_error`` (fail, skip, or report: a row with what went wrong); ``retries``, ``wait`` and ``timeout`` in seconds; ``token`` (bearer);
``per_partition``. Filters on ``request`` and on ``rank`` are pushed down: other requests aren't sent, and no more hits asked for than are wanted.

``fetch`` does the same for requests that are a DataFrame.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .ingest import SourceError

#: Of each kind: its columns besides request, rank and error; whether a failure ends the job; the most hits, as a search, a page or a list has them.
KINDS = {
    "web": ("url string, title string, text string, metadata map<string,string>", "fail", 20),
    "crawl": ("url string, title string, content string, metadata map<string,string>", "skip", 1),
    "papers": ("url string, title string, authors array<string>, abstract string, published string, doi string", "skip", 5),
    "transcripts": ("start double, text string", "skip", 1_000_000),
}


def schema_of(kind: str) -> str:
    return f"request string, rank int, {KINDS[kind][0]}, error string"


@dataclass(frozen=True)
class Asking:
    """How one kind of service is asked."""

    kind: str
    endpoint: str = ""
    client: str = ""
    limit: int = 0
    suffix: str = ""
    on_error: str = ""
    retries: int = 2
    wait: float = 0.5
    timeout: float = 30.0
    token: str = ""
    per_partition: int = 1

    @staticmethod
    def of(kind: str, options: dict[str, str]) -> Asking:
        given = {k.lower(): v for k, v in options.items()}
        kinds = {"limit": int, "retries": int, "per_partition": int, "wait": float, "timeout": float}
        own = {f: kinds.get(f, str)(given[f]) for f in Asking.__dataclass_fields__ if f != "kind" and f in given}
        out = Asking(kind, **own)
        if bool(out.endpoint) == bool(out.client):
            raise ValueError("a service has either an endpoint or a client")
        out = Asking(**{**out.__dict__, "limit": out.limit or KINDS[kind][2], "on_error": out.on_error or KINDS[kind][1]})
        if out.on_error not in ("fail", "skip", "report"):
            raise ValueError(f"on_error must be fail, skip or report, not {out.on_error!r}")
        return out


def named(path: str) -> Callable:
    """What ``module:name`` names."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def http(query: str, limit: int, asking: Asking) -> list[dict]:
    address = f"{asking.endpoint}?{urllib.parse.urlencode({'q': query, 'limit': limit})}"
    headers = {"Authorization": f"Bearer {asking.token}"} if asking.token else {}
    with urllib.request.urlopen(urllib.request.Request(address, headers=headers), timeout=asking.timeout) as answer:  # noqa: S310
        return json.loads(answer.read())


def _passing(why: Exception) -> bool:
    """Whether asking again may help."""
    return why.code in (408, 425, 429) or why.code >= 500 if isinstance(why, urllib.error.HTTPError) else isinstance(why, OSError)


def hits(request: str, asking: Asking, limit: int | None = None) -> Iterator[tuple]:
    """The rows of one request, as its kind's schema has them."""
    columns = [c.split()[0] for c in schema_of(asking.kind).split(", ")]
    most = asking.limit if limit is None else min(limit, asking.limit)
    if most <= 0:
        return
    ask = named(asking.client) if asking.client else http  # one that isn't there is an error, whatever becomes of failing requests
    try:
        for attempt in range(asking.retries + 1):
            try:
                found = ask(request + asking.suffix, most, asking)
                break
            except Exception as why:
                if attempt == asking.retries or not _passing(why):
                    raise
                time.sleep(asking.wait * 2**attempt)
        rows = [_row(request, rank, hit, columns) for rank, hit in enumerate(list(found)[:most], 1)]
    except Exception as why:
        if asking.on_error == "fail":
            raise SourceError(f"{asking.kind} source, {request}: {why}") from why
        rows = [_row(request, None, {"error": f"{type(why).__name__}: {why}"}, columns)] if asking.on_error == "report" else []
    yield from rows


def _row(request: str, rank: int | None, hit: dict, columns: list[str]) -> tuple:
    told = {k: {str(a): None if b is None else str(b) for a, b in v.items()} if isinstance(v, dict) else v for k, v in hit.items()}
    return tuple({"request": request, "rank": rank}.get(c, told.get(c)) for c in columns)


@dataclass
class Requests(InputPartition):
    names: list[str]
    limit: int | None


class ServiceReader(DataSourceReader):
    def __init__(self, asking: Asking, requests: list[str]):
        self.asking, self.requests, self.limit = asking, requests, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("request",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.requests = [r for r in self.requests if r in wanted]
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("rank",):
                most = f.value - isinstance(f, LessThan)
                self.limit = most if self.limit is None else min(self.limit, most)
                if self.asking.on_error == "report":  # such rows have no rank
                    yield f
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        n = max(1, self.asking.per_partition)
        return [Requests(self.requests[a : a + n], self.limit) for a in range(0, len(self.requests), n)] or [Requests([], self.limit)]

    def read(self, partition: Requests) -> Iterator[tuple]:
        for request in partition.names:
            yield from hits(request, self.asking, partition.limit)


class ServiceSource(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return f"quill_{cls.kind}"

    def schema(self) -> str:
        return schema_of(self.kind)

    def reader(self, schema: StructType) -> DataSourceReader:
        requests = json.loads(self.options.get("requests", "[]"))
        return ServiceReader(Asking.of(self.kind, dict(self.options)), list(dict.fromkeys(requests)))


class WebSource(ServiceSource):
    kind = "web"


class CrawlSource(ServiceSource):
    kind = "crawl"


class PaperSource(ServiceSource):
    kind = "papers"


class TranscriptSource(ServiceSource):
    kind = "transcripts"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, with filters pushed down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (WebSource, CrawlSource, PaperSource, TranscriptSource):
        spark.dataSource.register(source)


def fetch(requests: DataFrame, kind: str, column: str = "request", partitions: int | None = None, **options: str) -> DataFrame:
    """The rows of the distinct requests in a column, null ones left out; ``partitions`` of them are asked at once at most."""
    asking = Asking.of(kind, {k: str(v) for k, v in options.items()})
    schema = StructType.fromDDL(schema_of(kind))
    kinds = to_arrow_schema(schema)

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for request in batch.column(0).to_pylist():
                rows = list(hits(request, asking))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    asked = requests.select(F.col(column).cast("string").alias("request")).where("request is not null").distinct()
    return (asked.repartition(partitions, "request") if partitions else asked).mapInArrow(over, schema)
