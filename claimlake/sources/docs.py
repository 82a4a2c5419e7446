"""Readers of document trees and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from ..operators.nominate import capture_defaults
from ..schemas import SCHEMAS
from .tree import MAX_BYTES, RepoDocs

def read_repo_docs(spark: SparkSession, root: str, repo: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """repo, path, text of the rule files at a root and the Markdown under ``docs/``, dot-directories apart.

    Without ``repo``, each folder below the root is a repo.
    """
    spark.dataSource.register(RepoDocs)
    reader = spark.read.format("repo_docs").option("maxBytes", max_bytes)
    return (reader if repo is None else reader.option("repo", repo)).load(root)


def write_repo_docs(docs: DataFrame, root: str) -> None:
    """Each row's ``text`` as the file ``path`` of its ``repo``'s folder below a root."""
    docs.sparkSession.dataSource.register(RepoDocs)
    docs.select("repo", "path", "text").write.format("repo_docs").mode("append").save(root)


def capture_source(spark: SparkSession, folder: str, streaming: bool = False, files_a_batch: int | None = None) -> DataFrame:
    """Captured material as JSON lines in a folder, with defaults."""
    reader = (spark.readStream if streaming else spark.read).schema(SCHEMAS["captures"])
    if streaming and files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return capture_defaults(reader.json(folder))
