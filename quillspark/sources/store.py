"""Tables of the engine: reading, upserts by appending versions, partition overwrite, and the files that decide who wins.

Built-in file sources have no MERGE; the expert registry is a log of versions and its
latest view, which also removes the lost updates of rewriting one file.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "targets": "slug string, namespace string",
    "sources": "slug string, rank int, url string, title string, content string, source_type string, metadata map<string,string>",
    "chunks": "slug string, doc_id bigint, chunk_id int, n_tokens int, text string, metadata map<string,string>",
    "nodes": "slug string, node_id string, label string, properties map<string,string>",
    "relations": "slug string, src string, rel string, dst string, doc_id bigint, chunk_id int",
    "vectors": "namespace string, vec_id bigint, embedding array<float>, metadata map<string,string>",
    "expert_versions": "slug string, version bigint, topic string, persona_name string, description string, status string, source_count bigint, node_count bigint, relation_count bigint, created_at timestamp, storage_path string, namespace string",
    "messages": "expert_slug string, seq bigint, role string, content string, ts timestamp, turn string",
    "progress": "slug string, seq bigint, stage int, payload string",
    "course_text": "slug string, difficulty string, k int, delta string, error string, batch string",
}
PARTITIONED = {"chunks": "slug", "nodes": "slug", "relations": "slug", "vectors": "namespace", "messages": "turn", "course_text": "batch"}


class Store:
    """Tables under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str, must_exist: bool = False) -> DataFrame:
        """The table: what was appended, and what published builds hold. One that was never written is empty, or an error for an index that must exist."""
        from .builds import published

        held = published(self, name)
        try:
            own = self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND" or (must_exist and held is None):
                raise
            own = None
        if held is None:
            return self.spark.createDataFrame([], SCHEMAS[name]) if own is None else own
        return held if own is None else own.unionByName(held)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows. Spark's own appends to one folder keep unfinished files in one place, which the first of several to end deletes;
        so each is written in a folder of its own, and its files, whose names no other write has, go to the table when all are finished."""
        aside = f"{self.folder}/appending/{uuid.uuid4().hex}"
        try:
            self.writer(name, rows).parquet(aside)
            system, at = self._file(aside)
            base = system.makeQualified(at).toString()
            system.mkdirs(self._file(self.path(name))[1])
            files, found = system.listFiles(at, True), []
            while files.hasNext():
                found.append(files.next().getPath())
            for file in found:
                if not file.getName().startswith((".", "_")):
                    self.rename(file.toString(), self.path(name) + file.toString().removeprefix(base))
        finally:
            self.delete(aside)

    def replace(self, name: str, rows: DataFrame) -> None:
        """The partitions that ``rows`` has are replaced, others stay; a table without partitions is replaced whole."""
        self.writer(name, rows).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path(name))

    def writer(self, name: str, rows: DataFrame):
        by = PARTITIONED.get(name)
        writer = rows.select(*fields(SCHEMAS[name])).write
        return writer.partitionBy(by) if by else writer

    def create_vector_table(self, table: str) -> bool:
        """Create a catalog table of vectors unless it exists; whether it was created."""
        if self.spark.catalog.tableExists(table):
            return False
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (vec_id BIGINT, embedding ARRAY<FLOAT>, metadata MAP<STRING,STRING>, namespace STRING) USING parquet PARTITIONED BY (namespace)")
        return True

    def scratch(self) -> Scratch:
        return Scratch(self)

    # Files, through the file system that Spark itself uses for the folder.

    def _file(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def create(self, path: str) -> bool:
        """Create an empty file unless it is there; of several writers one alone is told that it did."""
        system, at = self._file(path)
        system.mkdirs(at.getParent())
        if system.getScheme() == "file":  # Hadoop's own local files look first and then write
            return self.spark._jvm.java.io.File(system.makeQualified(at).toUri().getPath()).createNewFile()
        try:
            system.create(at, False).close()
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def exists(self, path: str) -> bool:
        system, at = self._file(path)
        return system.exists(at)

    def listed(self, path: str) -> list[str]:
        """Names in a folder; none if it isn't there."""
        system, at = self._file(path)
        return sorted(f.getPath().getName() for f in system.listStatus(at) if not f.getPath().getName().startswith((".", "_"))) if system.exists(at) else []

    def rename(self, old: str, new: str) -> None:
        system, at = self._file(old)
        to = self.spark._jvm.org.apache.hadoop.fs.Path(new)
        system.mkdirs(to.getParent())
        if not system.rename(at, to):
            raise OSError(f"{old} can't be renamed to {new}")

    def delete(self, path: str) -> bool:
        system, at = self._file(path)
        return system.delete(at, True)


class Scratch:
    """Tables of one run, written and reread; ``forget`` deletes them."""

    def __init__(self, store: Store):
        self.store, self.folder = store, f"{store.folder}/scratch/{uuid.uuid4().hex}"

    def __call__(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{self.folder}/{name}")
        return self.store.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def forget(self) -> None:
        self.store.delete(self.folder)


def fields(schema: str) -> list[str]:
    """The column names of a schema."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [x.split()[0] for x in (*out, schema[start:].strip())]
