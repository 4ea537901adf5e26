"""Builds as transactions: what a build writes is seen whole or not at all.

A build gets a number of its own from a log, by creating the number's file, which only one writer can. Its tables go
to partitions of that number, which no reader looks into before the number is published, by the creation of one more file.
Of an expert's published builds the one of the highest number counts; its vectors add to those of the builds before, back to the last
that replaced them. A build that fails leaves partitions that nothing reads; another can adopt what was finished of it, and
``vacuum`` deletes it.
"""

from __future__ import annotations

import hashlib
import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import PARTITIONED, SCHEMAS, Store, fields

#: Tables that a build writes, in the order in which a reader could need them. Of logs every published row counts, of the others an expert's last build.
TABLES = ("sources", "chunks", "relations", "nodes", "vectors", "progress", "expert_versions")
LOGS = ("progress", "expert_versions")
MODES = ("append", "replace")


class Conflict(RuntimeError):
    """A number that another writer has taken or published."""


class Log:
    """Numbers begun and published, as files whose names say it all."""

    def __init__(self, store: Store):
        self.store, self.folder = store, f"{store.folder}/log"

    def _named(self, kind: str) -> list[str]:
        return self.store.listed(f"{self.folder}/{kind}")

    def begin(self, least: int = 1) -> int:
        """The next number that is this writer's alone."""
        number = max([least - 1, *map(int, self._named("begun"))])
        while True:
            number += 1
            if self.store.create(f"{self.folder}/begun/{number:012d}"):
                return number

    def publish(self, number: int, mode: str) -> None:
        if mode not in MODES:
            raise ValueError(f"mode must be append or replace, not {mode!r}")
        if not self.store.create(f"{self.folder}/published/{number:012d}-{mode}"):
            raise Conflict(f"build {number} is published already")

    def published(self) -> dict[int, str]:
        """The mode of each published number."""
        return {int(m[1]): m[2] for m in (re.fullmatch(r"(\d+)-(\w+)", x) for x in self._named("published")) if m}

    def begun(self) -> list[int]:
        return sorted(map(int, self._named("begun")))


class Build:
    """One build's own partitions."""

    def __init__(self, store: Store, number: int):
        self.store, self.number = store, number

    def path(self, name: str) -> str:
        return f"{built(self.store, name)}/build={self.number}"

    def staged(self, name: str) -> bool:
        return self.store.exists(f"{self.path(name)}/_SUCCESS")

    def read(self, name: str) -> DataFrame:
        return self.store.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))

    def stage(self, name: str, rows) -> DataFrame:
        """Write a table of this build and give it reread. ``rows`` is called only if the table isn't finished yet."""
        if not self.staged(name):
            self.store.writer(name, rows()).mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def adopt(self, failed: int) -> list[str]:
        """Take over the finished tables of a build that wasn't published."""
        if failed in Log(self.store).published():
            raise Conflict(f"build {failed} is published")
        other, taken = Build(self.store, failed), []
        for name in ("targets", *TABLES):
            # What says how a build ended is written anew.
            if name not in LOGS and other.staged(name) and not self.staged(name):
                self.store.rename(other.path(name), self.path(name))
                taken.append(name)
        return taken


def built(store: Store, name: str) -> str:
    return f"{store.folder}/built/{name}"


def live(store: Store, name: str, modes: dict[int, str]) -> DataFrame:
    """(build, slug, namespace) of the builds that count for a table: each expert's last, and of vectors those it added to."""
    targets = _of(store, "targets", list(modes))
    said = store.spark.createDataFrame(list(modes.items()), "build long, mode string")
    every = targets.join(F.broadcast(said), "build")
    first = F.max(F.when(F.col("mode") == "replace", F.col("build"))) if name == "vectors" else F.max("build")
    since = every.groupBy("slug").agg(F.coalesce(first, F.lit(0)).alias("since"))
    return every.join(since, "slug").where("build >= since").select("build", "slug", "namespace")


def _of(store: Store, name: str, numbers: list[int]) -> DataFrame:
    """The rows of some builds, with their number. A build that lacks the table has no rows of it."""
    base = built(store, name)
    paths = [p for n in numbers if store.exists(p := f"{base}/build={n}")]
    schema = f"{SCHEMAS[name]}, build long"
    if not paths:
        return store.spark.createDataFrame([], schema)
    return store.spark.read.schema(schema).option("basePath", base).parquet(*paths)


def published(store: Store, name: str) -> DataFrame | None:
    """The rows of a table that published builds give; none without such builds."""
    modes = Log(store).published()
    if name not in TABLES or not modes:
        return None
    rows, columns = _of(store, name, list(modes)), fields(SCHEMAS[name])
    if name not in LOGS:
        key = "namespace" if name == "vectors" else "slug"
        rows = rows.join(live(store, name, modes).select("build", key), ["build", key], "left_semi")
    return rows.select(*columns)


def compare_and_set(store: Store, slug: str, expected: int | None, **changes: object) -> int:
    """Write a new version of one expert if its last one is still ``expected`` (none: it mustn't be there); gives the version.

    Of several writers who have seen the same version one alone wins, by creating the file that claims what comes after it; the others get
    ``Conflict`` and may look again. A version that is claimed but never written, by a writer that was lost, is taken over by ``retake``.
    """
    from ..operators.registry import latest

    now = latest(store.read("expert_versions").where(F.col("slug") == slug)).collect()
    found = now[0].version if now else None
    if found != expected:
        raise Conflict(f"{slug} is at version {found}, not {expected}")
    names = fields(SCHEMAS["expert_versions"])
    if wrong := set(changes) - set(names):
        raise ValueError(f"an expert has no {', '.join(sorted(wrong))}")
    if not store.create(claim_of(store, slug, expected)):
        raise Conflict(f"version {expected} of {slug} has been followed by another writer")
    version = 2 * Log(store).begin((expected or 0) // 2 + 1)
    held = {c: now[0][c] for c in names} if now else {"status": "pending", "created_at": datetime.now(UTC), "source_count": 0, "node_count": 0, "relation_count": 0, "description": ""}
    row = {**dict.fromkeys(names), **held, **changes, "slug": slug, "version": version}
    store.append("expert_versions", store.spark.createDataFrame([tuple(row[c] for c in names)], SCHEMAS["expert_versions"]))
    return version


def retake(store: Store, slug: str, expected: int | None) -> bool:
    """Withdraw the claim of a writer that is known to be lost; whether there was one."""
    return store.delete(claim_of(store, slug, expected))


def claim_of(store: Store, slug: str, expected: int | None) -> str:
    """The file that claims the version after ``expected``."""
    return f"{store.folder}/log/claims/{hashlib.sha256(slug.encode()).hexdigest()}-{expected or 0:020d}"


def vacuum(store: Store, keep: tuple[int, ...] = ()) -> list[int]:
    """Delete builds that were begun and never published, but for those of ``keep`` (still running, or to be adopted); published
    ones that no expert's tables rest on any longer are deleted too. Gives the numbers."""
    log = Log(store)
    modes = log.published()
    needed = set(keep)
    if modes:
        needed |= {r.build for r in live(store, "vectors", modes).select("build").distinct().collect()}  # as many as builds at most
    gone = [n for n in log.begun() if n not in needed]
    for n in gone:
        for name in ("targets", *TABLES):
            if name not in LOGS or n not in modes:
                store.delete(f"{built(store, name)}/build={n}")
    return gone


assert set(TABLES) <= set(SCHEMAS) and set(PARTITIONED) <= {*TABLES, "messages", "course_text"}
