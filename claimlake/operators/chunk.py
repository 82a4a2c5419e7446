"""Documents into line-addressed chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import chunk_statement, normalizer

CHUNK_LINES = 40
FENCE = "```"
_DOC = ["repo", "path"]
_PARTS = pa.list_(pa.struct([("line_start", pa.int32()), ("line_end", pa.int32()), ("heading", pa.string()), ("text", pa.string())]))
#: What is known of a section without its text.
SECTION = ("line_start", "line_end", "level", "title", "symbol_path")


def split_lines(text: Column) -> Column:
    """Lines without the empty one after a last line break."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def chunk_documents(files: DataFrame, lines_per_chunk: int = CHUNK_LINES) -> DataFrame:
    """``files`` (repo, path, text) to repo, path, ordinal, heading, line_start, line_end, text, content_sha256, statement.

    A heading outside fences opens a chunk, and so does every ``lines_per_chunk``-th
    buffered line outside fences. Text is trimmed and blank chunks are dropped; a bare
    ``#`` keeps the heading before it. A row is a document, and no line leaves it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                parts = pa.array([_cut(t, lines_per_chunk) for t in part.column(2).to_pylist()], _PARTS)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], parts], names=["repo", "path", "parts"])

    kind = "array<struct<line_start:int,line_end:int,heading:string,text:string>>"
    cut = files.select(*_DOC, "text").mapInArrow(run, f"repo string, path string, parts {kind}")
    trimmed = lambda p: p.withField("text", F.regexp_replace(p["text"], r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$", ""))
    out = cut.select(*_DOC, F.posexplode(F.filter(F.transform("parts", trimmed), lambda p: p["text"] != "")).alias("ordinal", "p")).select(*_DOC, "ordinal", "p.*")
    return out.select(
        *_DOC, "ordinal", "heading", "line_start", "line_end", "text", F.sha2("text", 256).alias("content_sha256"),
        chunk_statement(F.col("heading"), F.col("path"), F.col("text")).alias("statement"),
    )


def _cut(text: str | None, lines_per_chunk: int) -> list[dict]:
    """A document's chunks, in one pass over its lines; blank ones too."""
    lines = lines_of(text)
    parts, begin, heading, fence_open = [], 0, "", False

    def close(end: int) -> None:
        if end > begin:
            parts.append({"line_start": begin + 1, "line_end": end, "heading": heading, "text": "\n".join(lines[begin:end])})

    for k, line in enumerate(lines):
        is_fence = FENCE in line and line.strip(" ").startswith(FENCE)
        fence_open ^= is_fence
        if line.startswith("#") and not fence_open and not is_fence:
            close(k)
            begin, heading = k, line.lstrip("#").strip(" ") or heading
        if k + 1 - begin >= lines_per_chunk and not fence_open:
            close(k + 1)
            begin = k + 1
    close(len(lines))
    return parts


def heading_sections(files: DataFrame, names: tuple[str, ...] = SECTION) -> DataFrame:
    """``files`` to repo, path, line_start, line_end, level, title, symbol_path (or those of ``names``) of every heading outside fences.

    A section ends before the next heading of any level; its path joins its ancestors.
    """
    return with_sections(files, names).select(*_DOC, F.inline("sections"))


def with_sections(files: DataFrame, names: tuple[str, ...] = SECTION, marks: Callable[..., Iterable[tuple]] | None = None, given: tuple[str, ...] = ()) -> DataFrame:
    """``files``, one row a document, to repo, path and its ``sections`` in the order of lines, with the columns ``names``.

    ``marks`` makes marks (line, level, title) in the order of lines of a document's lines
    and the columns ``given``; without it, they are the headings and fences. ``node_hash``
    can be named besides ``SECTION``.
    """
    every = (*SECTION, "node_hash")
    chosen, hashed = itemgetter(*[every.index(n) for n in names]), "node_hash" in names
    picked = chosen if len(names) > 1 else lambda s: (chosen(s),)
    whole = names == SECTION

    def of(text: str | None, *rest) -> list[tuple]:
        lines = lines_of(text)
        found = outline(len(lines), headings(lines) if marks is None else marks(lines, *rest))
        if hashed:
            norm = normalizer(text)
            found = [(*s, norm("\n".join(lines[s[0] - 1 : s[1]]))) for s in found]
        return found if whole else list(map(picked, found))

    return per_document(files, _DOC, list(given), of, {n: pa.int32() if n in ("line_start", "line_end", "level") else pa.string() for n in names}, "sections")


def per_document(rows: DataFrame, keep: list[str], given: list[str], of: Callable[..., list[tuple]], kinds: dict[str, pa.DataType], name: str) -> DataFrame:
    """``keep`` and, as ``name``, the list of structs that ``of`` makes of a document's text, decoded, and the columns ``given``; no text comes back from Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for at in range(0, batch.num_rows, 64):
                taken = [c.slice(at, 64).to_pylist() for c in batch.columns[len(keep) :]]
                found = [of(None if t is None else t.decode("utf-8", "replace"), *rest) for t, *rest in zip(*taken, strict=True)]
                ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
                flat = list(zip(*chain.from_iterable(found), strict=True)) or [()] * len(kinds)
                parts = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(flat, kinds.values(), strict=True)], list(kinds))
                done.append(pa.ListArray.from_arrays(ends, parts))
            if done:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.concat_arrays(done)], names=[*keep, name])

    made = ArrayType(StructType([StructField(n, IntegerType() if k == pa.int32() else StringType()) for n, k in kinds.items()]))
    kept = rows.select(*keep)
    return rows.select(*keep, F.col("text").cast("binary"), *given).mapInArrow(run, StructType([*kept.schema, StructField(name, made)]))


def lines_of(text: str | None) -> list[str]:
    """As :func:`split_lines`."""
    lines = (text or "").split("\n")
    if not lines[-1]:
        lines.pop()
    return lines


def headings(lines: list[str]) -> Iterator[tuple[int, int, str | None]]:
    """(line, level, title) of headings and, without a title, of fences."""
    for n, line in enumerate(lines, 1):
        if line.startswith("#"):
            bare = line.lstrip("#")
            yield n, len(line) - len(bare), bare.strip(" ")
        elif FENCE in line and line.lstrip(" ").startswith(FENCE):
            yield n, 0, None


def outline(n_lines: int, marks: Iterable[tuple[int, int, str | None]]) -> list[tuple[int, int, int, str, str]]:
    """Sections (line_start, line_end, level, title, symbol_path) of a document of ``n_lines``.

    A mark without a title is a fence, and what stands between two of them is no
    section. A stack of open ancestors gives the paths, in one pass over the marks.
    """
    found, stack, fenced, last = [], [], False, None
    for mark in marks:
        line, level, title = mark
        if title is None:
            fenced = not fenced
        elif not fenced:
            if last is not None:
                found.append((last[0], line - 1, last[1], last[2], path))
            while stack and stack[-1][0] >= level:
                stack.pop()
            path = f"{stack[-1][1]} > {title}" if stack else title
            stack.append((level, path))
            last = mark
    if last is not None:
        found.append((last[0], n_lines, last[1], last[2], path))
    return found
