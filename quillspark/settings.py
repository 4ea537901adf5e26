"""Settings, read once from the session's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "quillspark."


@dataclass(frozen=True)
class Settings:
    storage: str = "storage"
    namespace_prefix: str = "expert"
    max_sources: int = 20
    crawls: int = 5
    papers: int = 5
    max_paths_per_chunk: int = 15
    chunks: str = "windows"
    chunk_vocabulary: str = ""
    chunk_tokens: int = 512
    chunk_overlap: int = 64
    top_k: int = 5
    context_chars: int = 3000
    synthesis: str = "first"
    near_nodes: int = 20
    history: int = 20
    max_tokens: int = 8192


def settings(spark: SparkSession) -> Settings:
    """The defaults, with what ``quillspark.<name>`` says in the session, in any case of letters."""
    said = {f.name: spark.conf.get(PREFIX + f.name, None) for f in fields(Settings)}
    return Settings(**{f.name: type(f.default)(said[f.name]) for f in fields(Settings) if said[f.name] is not None})
