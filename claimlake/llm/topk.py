"""Exact top-k by inner product: the threshold algorithm over sorted lists, one a dimension.

A shard of the rows keeps, for each dimension, its rows in the order of that component.
A query goes down all lists at once, from the end that its component's sign favours,
and scores each row that it meets for the first time against the whole vector. What a
row that no list has shown yet can score at most is the query times the components at
which the lists stand; once that is below the k-th best score, no further row can
count. At equal scores a smaller id could still come, so the walk ends below only.
The best of each shard are merged.

Defined results: vectors that are null, empty, or hold null or non-finite components,
and rows without an id, take no part; vectors of different widths have no product;
fewer candidates than k give what there is; ties go to the smaller id; equal rows count
once; rows of one id with different vectors are rows of their own, of which a query
meets none with its own id; empty tables give none; extra columns are ignored. It is
an error if a score can't be held in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann import top
from .blocks import finite, matrix, meet, products, scaled
from .common import written

#: Entries of each list that a query reads first; each further step reads twice as many.
STEP = 8


class Lists:
    """The sorted lists of a shard."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        self.order = np.ascontiguousarray(np.argsort(v, axis=0, kind="stable").T.astype(np.int32))

    def best(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best rows but those with the id ``own``, their scores, and how many rows were scored."""
        up, down = np.nonzero(q > 0)[0], np.nonzero(q < 0)[0]
        if not len(up) + len(down):
            down = np.zeros(1, np.int64)  # all scores are zero: one list names all rows
        n, depth, step, scored = len(self.ids), 0, STEP, 0
        seen = self.ids == own
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while depth < n:
            to = min(n, depth + step)
            met = np.concatenate([self.order[up, n - to : n - depth].ravel(), self.order[down, depth:to].ravel()])
            new = np.unique(met[~seen[met]])
            seen[new] = True
            scored += len(new)
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, products(self.v[new], q)])
            first = np.lexsort((self.ids[rows], -scores))[:k]
            rows, scores = rows[first], scores[first]
            if len(rows) == k:
                bound = sum(int(q[d]) * int(self.v[self.order[d, n - to], d]) for d in up) + sum(int(q[d]) * int(self.v[self.order[d, to - 1], d]) for d in down)
                if bound < scores[-1]:
                    break
            depth, step = to, 2 * step
        return rows, scores, scored


def _build(shard: pa.Table) -> Lists:
    return Lists(shard["vec_id"].to_numpy(), matrix(shard["v"], shard.num_rows))


def exact_top(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """``rows`` (vec_id, embedding): query_id, rank, vec_id, score of the k best other rows of each query row.

    The score is the inner product of floor(scale * x) of both vectors.
    """
    good = rows.select("vec_id", F.col("embedding").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("vec_id").isNotNull() & finite(F.col("v")))
    whole = good.select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled(F.col("v"), scale).alias("v"), "asks")
    # equal rows are one before anything is dealt out
    once = whole.groupBy("vec_id", "v").agg(F.max("asks").alias("asks"))
    points = written(once.withColumn("key", F.xxhash64("vec_id", "v")))

    def search(lists: Lists, asks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, keys, q = asks["vec_id"].to_numpy(), asks["key"].to_numpy(), matrix(asks["v"], asks.num_rows)
        out = [(ids[i], keys[i], *lists.best(ids[i], q[i], k)) for i in range(len(ids))]
        n = [len(o[2]) for o in out]
        found = [np.repeat(ids, n), np.repeat(keys, n), lists.ids[np.concatenate([o[2] for o in out])], np.concatenate([o[3] for o in out])]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "qkey", "vec_id", "score"])

    cols = points.select("vec_id", "key", "v")
    found = meet(cols, points.filter("asks").select("vec_id", "key", "v"), _build, search, "query_id bigint, qkey bigint, vec_id bigint, score bigint")
    return top(found, ["query_id", "qkey"], [F.desc("score"), "vec_id"], k, "rank").select("query_id", "rank", "vec_id", "score")


#: The same by brute force. Only for tables in which an id stands on one vector.
SQL = """WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5"""
