"""Stated queries against all rows, in blocks, and vectors of integers.

Rows are dealt into shards of a bounded size and queries into blocks. Each block meets
each shard in one task, which builds an index of the shard once and streams the block
past it. No task holds more than a shard, whatever the size of either table.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a shard at most, about, and at least while there are tasks to be had; queries of a block.
SHARD, LEAST, BLOCK = 16_384, 1024, 4096
#: Components beyond this are an error, as a double can't tell such integers apart.
EXACT = 1 << 53


def finite(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components."""
    each = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & each, F.lit(False))


def scaled(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * x) + shift of each component, x as double; an error where that isn't exact."""

    def one(x: Column) -> Column:
        large = F.raise_error(F.lit("a component is too large to be an exact integer")).cast("bigint")
        return F.when(F.abs(x) * scale < EXACT // 2, F.floor(x * scale) + shift).otherwise(large)

    return F.transform(vector.cast("array<double>"), one)


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``v`` with ``q``; an error beyond 64 bits."""
    if not v.size:
        return np.zeros(len(v), np.int64)
    bound = v.shape[1] * int(np.abs(v).max()) * int(np.abs(q).max())
    if bound < EXACT:
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return v @ q
    return np.array([sum(map(int.__mul__, row, q.tolist())) for row in v.tolist()], np.int64)


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Slices of one pair and kind: ((pair, width), whether they ask, rows)."""
    pair, width, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
    change = (np.diff(pair) != 0) | (np.diff(width) != 0) | (np.diff(asks.astype(np.int8)) != 0)
    edges = [0, *(np.nonzero(change)[0] + 1).tolist(), batch.num_rows]
    for a, z in itertools.pairwise(edges):
        if z > a:
            yield (pair[a], width[a]), bool(asks[a]), batch.slice(a, z - a)


def meet(
    held: DataFrame,
    asked: DataFrame,
    build: Callable[[pa.Table], Any],
    search: Callable[[Any, pa.RecordBatch], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """What ``search`` finds for each of ``asked`` in each shard of ``held``.

    Both are tables with the same columns, ``v`` (integers) and ``key`` (64 bits that
    tell the rows apart) among them; only vectors of one width meet. ``build`` gets a
    shard, ``search`` its index and some of the queries.
    """
    spark, cols = held.sparkSession, held.columns
    rows, queries = held.count(), asked.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-rows // SHARD), min(tasks, rows // LEAST))
    blocks = max(1, -(-queries // BLOCK))
    deal = lambda n: F.pmod("key", F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = held.select(deal(shards).alias("_s"), every(blocks).alias("_b"), F.lit(False).alias("_asks"), *cols)
    b = asked.select(every(shards).alias("_s"), deal(blocks).alias("_b"), F.lit(True).alias("_asks"), *cols)
    both = a.unionByName(b).select((F.col("_b") * shards + F.col("_s")).alias("_pair"), F.size("v").alias("_w"), "_asks", *cols)
    dealt = both.repartitionById(shards * blocks, "_pair").sortWithinPartitions("_pair", "_w", "_asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, index = None, [], None
        for batch in batches:
            for at, asks, part in _cut(batch):
                if at != now:
                    now, pieces, index = at, [], None
                if not asks:
                    pieces.append(part)
                elif pieces:
                    if index is None:
                        index = build(pa.Table.from_batches(pieces))
                    yield from search(index, part)

    return dealt.mapInArrow(run, schema)
