"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import forget, release, scratch_dir, written

__all__ = ["forget", "held_out", "join_hot", "kept_tool", "mix64", "per_batch", "per_row", "per_row_many", "release", "scratch_dir", "words", "written"]

T = TypeVar("T")
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def join_hot(big: DataFrame, small: DataFrame, on: list[str], rows: str) -> DataFrame:
    """``big`` joined to ``small``, which has each key once and in ``rows`` how many rows of ``big`` have it.

    Keys with more than a thousandth of the rows, which are a thousand at most, are
    sent to every task; the others are shuffled. So no key is one task's.
    """
    total, most = small.agg(F.sum(rows), F.max(rows)).first()
    limit = max(1000, (total or 0) / 1000)
    if (most or 0) <= limit:
        return big.join(small, on)
    hot = small.filter(F.col(rows) > limit)
    cold = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.filter(F.col(rows) <= limit), on)
    return big.join(F.broadcast(hot), on).unionByName(cold)


def held_out(doc_id: Column) -> Column:
    """True for rows whose crc32(doc_id as text) mod 3 is 1: never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _fields(df: DataFrame, schema: str | StructType) -> StructType:
    return df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema


def per_row(
    df: DataFrame, schema: str | StructType, make: Callable[[], Callable[..., tuple]], inputs: list[str]
) -> DataFrame:
    """Apply a per-row helper over Arrow batches.

    ``make()`` runs once per task and returns ``f(*inputs) -> tuple`` matching
    ``schema``. Only ``inputs`` are sent to Python.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = _fields(df, schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in range(0, batch.num_rows, 1024):
                piece = batch.slice(part, 1024)
                rows = [f(*row) for row in zip(*(c.to_pylist() for c in piece.columns), strict=True)]
                cols = zip(*rows, strict=True) if rows else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return df.select(*inputs).mapInArrow(run, fields)


def per_batch(
    df: DataFrame, schema: str | StructType, make: Callable[[], Callable[..., tuple]], inputs: list[str], rows: int = 1024
) -> DataFrame:
    """As :func:`per_row`, but the helper takes and returns lists, one for each column."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = _fields(df, schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in range(0, batch.num_rows, rows):
                cols = f(*(c.to_pylist() for c in batch.slice(part, rows).columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return df.select(*inputs).mapInArrow(run, fields)


def per_row_many(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[..., list[tuple]]], inputs: list[str]) -> DataFrame:
    """As :func:`per_row`, but the helper returns a list of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = _fields(df, schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                piece = batch.slice(part, 256)
                rows = [out for row in zip(*(c.to_pylist() for c in piece.columns), strict=True) for out in f(*row)]
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return df.select(*inputs).mapInArrow(run, fields)


_KEPT: dict = {}


def kept_tool(key: Hashable, make: Callable[[], T]) -> T:
    """A tool that a Python worker makes once and keeps until it needs another one.

    Workers outlive a stage, so only the last tool is kept: an earlier stage's memory
    doesn't add to a later one's.
    """
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        _KEPT[key] = make()
    return _KEPT[key]


def words(text: str | None) -> list[bytes]:
    """The runs of ``[^\\x20\\x09-\\x0D]`` in a text, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix64(x):
    """A 64-bit finaliser over a NumPy array of unsigned integers."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_MIX[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))
