"""``repo_docs``: a Spark data source of document trees, and a sink that writes them.

Reading gives repo, path and text of the rule files at a root and of the Markdown under
``docs/``, files whose names begin with a dot included, dot-directories apart. The driver
lists names and sizes, as for Spark's own file sources, and deals them to tasks of bounded
bytes; tasks read the files. So a folder with most of the files is read by many tasks.

Writing puts each row's text into ``<root>/<repo>/<path>``. A task that runs again writes
the same bytes to the same places.

Folders are reached through ``pyarrow.fs``: a mounted path or one of its URIs.

Options: ``repo`` names the tree; without it each folder below the root is a repo, as the
sink lays them out. ``maxBytes`` is the largest file that is read.

Defined results: a missing root is an error, one without such files gives no rows; bytes
that are no UTF-8 become replacement characters; a null text is written as an empty file;
null or escaping paths are errors; of rows with one path any one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Files looked for at a root, beside ``docs/**/*.md``; and the largest file that is read. Fixed values.
ROOT_FILES = ("AGENTS.md", "CLAUDE.md", "README.md", ".cursorrules", ".windsurfrules")
MAX_BYTES = 512 * 1024
#: What a task reads, at most; a file counts for OPEN_BYTES more than it has.
TASK_BYTES, OPEN_BYTES = 64 << 20, 16 << 10
#: Bytes of an Arrow batch, about.
BATCH_BYTES = 8 << 20

SCHEMA = "repo string, path string, text string"
_ARROW = pa.schema([(n, pa.string()) for n in ("repo", "path", "text")])


def _opened(root: str):
    from pyarrow.fs import FileSystem

    files, at = FileSystem.from_uri(root)
    return files, at.rstrip("/")


@dataclass
class Span(InputPartition):
    """Names of files by folder: repo, root of the repo, folder below it, names."""

    named: tuple[tuple[str, str, str, tuple[str, ...]], ...]


def _listed(files, folder: str):
    """Folders and files (name, size) in a folder, by name."""
    from pyarrow.fs import FileSelector, FileType

    found = sorted(files.get_file_info(FileSelector(folder)), key=lambda i: i.base_name)
    return [i.base_name for i in found if i.type == FileType.Directory], [(i.base_name, i.size) for i in found if i.type == FileType.File]


def _wanted(folder: str, name: str) -> bool:
    return name.lower().endswith(".md") if folder else name in ROOT_FILES


class TreeReader(DataSourceReader):
    def __init__(self, root: str, repo: str | None, max_bytes: int):
        self.root, self.repo, self.max_bytes = root, repo, max_bytes

    def partitions(self) -> list[Span]:
        files, at = _opened(self.root)
        repos = [(self.repo, at)] if self.repo is not None else [(name, f"{at}/{name}") for name in _listed(files, at)[0]]
        spans, named, held = [], [], 0
        for repo, top in repos:
            below = [""]
            while below:
                folder = below.pop()
                folders, own = _listed(files, f"{top}/{folder}".rstrip("/"))
                inside = [f for f in folders if not f.startswith(".")] if folder else [f for f in folders if f == "docs"]
                below += [f"{folder}/{f}".lstrip("/") for f in inside]
                names: list[str] = []
                for name, size in own:
                    if not _wanted(folder, name) or size > self.max_bytes:
                        continue
                    names.append(name)
                    held += size + OPEN_BYTES
                    if held >= TASK_BYTES:
                        spans.append(Span((*named, (repo, top, folder, tuple(names)))))
                        named, names, held = [], [], 0
                if names:
                    named.append((repo, top, folder, tuple(names)))
        return [*spans, Span(tuple(named))] if named or not spans else spans

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(self.root)
        rows, held = [], 0
        for repo, top, folder, names in partition.named:
            for name in names:
                path = f"{folder}/{name}".lstrip("/")
                with files.open_input_stream(f"{top}/{path}") as stream:
                    data = stream.read()
                rows.append((repo, path, data.decode("utf-8", "replace")))
                held += len(data)
                if held >= BATCH_BYTES or len(rows) >= 4096:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=_ARROW)


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, at = _opened(self.root)
        made = set()
        for batch in iterator:
            repos, paths, texts = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("repo", "path", "text"))
            for repo, path, text in zip(repos, paths, texts, strict=True):
                parts = [*(repo or "").split("/"), *(path or "").split("/")]
                if any(p in ("", ".", "..") for p in parts):
                    raise ValueError(f"no place below the root: {repo!r}, {path!r}")
                folder = "/".join((at, *parts[:-1]))
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                with files.open_output_stream(f"{folder}/{parts[-1]}") as stream:
                    stream.write((text or "").encode("utf-8", "surrogatepass"))
        return WriterCommitMessage()


class RepoDocs(DataSource):
    """``spark.read.format("repo_docs").option("repo", name).load(root)``, and ``df.write.format("repo_docs").mode("append").save(root)``."""

    @classmethod
    def name(cls) -> str:
        return "repo_docs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("repo"), int(self.options.get("maxBytes", MAX_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("repo_docs adds files to a tree; take another root for a new one")
        return TreeWriter(self.options["path"])
