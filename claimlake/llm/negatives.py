"""Hard negatives through rotated one-bit codes.

A vector is written as a sum of sign vectors, coarse to fine. Each level turns what is
left by a fixed rotation of its own, which spreads it evenly; the signs are its code,
and the alignment of the rest with its code is stored beside it, with the length of
what then still is left. A query's rotated vector is cut into bit planes, so that its product with a code is a few
popcounts. By Cauchy and Schwarz the product with what is left lies within the lengths
of both, without the part of the query along the last code, as the rest is at right
angles to it. So each level gives an interval that holds the true score for certain.
Rows whose interval can't be among the best are let go level by level, and what
survives is scored in integers. Intervals bound, they never decide: results are exact.

An anchor's positives are found first, then the negatives of all its positives at
once, in bands of scores. Anchors meet the rows in blocks (see ``blocks``), whatever
their labels, so no label is a group of its own.

Defined results: rows with a null label, a null id, or a vector that is null, empty or
holds null or non-finite components take no part; vectors of different widths have no
score; fewer rows than asked for give what there is; ties go to the smaller id; equal
rows count once; no row with the anchor's own id is its positive or negative; empty
tables give none; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann import top
from .blocks import finite, matrix, meet, products, scaled
from .common import kept_tool, written

#: Codes of a vector, bits of a query's component, the rotation's seed, and what rounding can add to a bound of unit vectors.
LEVELS, BITS, SEED, ROUNDING = 6, 8, 17, 1e-6


class Codec:
    """Codes of vectors of one width."""

    def __init__(self, width: int):
        self.bits = -(-width // 64) * 64
        rng = np.random.default_rng(SEED)
        self.steps = [np.linalg.qr(rng.normal(size=(self.bits, self.bits)))[0] for _ in range(LEVELS)]
        self.steps[0] = self.steps[0][:width]
        self.turns = list(itertools.accumulate(self.steps, np.matmul))

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (rows, levels, words), alignments and lengths of the rests (rows, levels)."""
        rest = v.astype(np.float64)
        codes, along, left = [], [], []
        for step in self.steps:
            rest = rest @ step
            bits = rest >= 0
            a = np.abs(rest).sum(axis=1) / np.sqrt(self.bits)
            rest = rest - np.where(bits, a[:, None], -a[:, None]) / np.sqrt(self.bits)
            codes.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
            along.append(a)
            left.append(np.linalg.norm(rest, axis=1))
        return np.stack(codes, axis=1), np.stack(along, axis=1), np.stack(left, axis=1)

    def planes(self, q: np.ndarray, level: int) -> tuple[np.ndarray, float, float, float, float]:
        """A query's bit planes, their offset and unit, the sum of all its cut components, and what cutting them can change."""
        y = q.astype(np.float64) @ self.turns[level]
        low, unit = y.min(), (y.max() - y.min()) / (2**BITS - 1) or 1.0
        cut = np.rint((y - low) / unit).astype(np.int64)
        planes = np.stack([np.packbits(cut >> b & 1, bitorder="little").view(np.uint64) for b in range(BITS)])
        approx = low + unit * cut
        return planes, low, unit, approx.sum(), np.abs(y - approx).sum() / np.sqrt(self.bits)


def codec(width: int) -> Codec:
    return kept_tool(("rotation", width), lambda: Codec(width))


class Shard:
    def __init__(self, rows: pa.Table):
        self.ids, self.labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        self.v = matrix(rows["v"], rows.num_rows)
        self.along, self.left = (matrix(rows[c], rows.num_rows) for c in ("along", "left"))
        self.codes = matrix(rows["codes"], rows.num_rows).view(np.uint64).reshape(rows.num_rows, LEVELS, -1)
        self.norm = np.sqrt((self.v.astype(np.float64) ** 2).sum(axis=1))

    def levels(self, q: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows with the bounds of their scores, level by level; the caller sends back which of them stay."""
        tool = codec(len(q))
        size = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        guess, doubt = np.zeros(len(rows)), ROUNDING * size * self.norm[rows]
        least, most = np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
        for level in range(LEVELS):
            planes, low, unit, total, slip = tool.planes(q, level)
            code = self.codes[rows, level]
            ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
            cut = sum(np.bitwise_count(code & planes[b]).sum(axis=1, dtype=np.int64) << b for b in range(BITS))
            t = (2 * (low * ones + unit * cut) - total) / np.sqrt(tool.bits)
            a = self.along[rows, level]
            guess, doubt = guess + a * t, doubt + a * slip
            across = np.sqrt(np.maximum(0, size**2 - np.maximum(0, np.abs(t) - slip) ** 2))
            half = doubt + self.left[rows, level] * across
            least, most = np.maximum(least, guess - half), np.minimum(most, guess + half)
            stay = yield rows, least, most
            rows, guess, doubt, least, most = (x[stay] for x in (rows, guess, doubt, least, most))
        yield rows, least, most

    def positives(self, own: int, label: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of the label."""
        walk = self.levels(q, np.nonzero((self.labels == label) & (self.ids != own))[0])
        rows, least, most = next(walk)
        for _ in range(LEVELS):
            floor = np.partition(least, len(rows) - k)[len(rows) - k] if len(rows) > k else -np.inf
            rows, least, most = walk.send(most >= floor)
        return first(self.ids[rows], products(self.v[rows], q), k)

    def negatives(self, own: int, label: int, q: np.ndarray, bands: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the k best rows of other labels in each band of scores."""
        walk = self.levels(q, np.nonzero((self.labels != label) & (self.ids != own))[0])
        rows, least, most = next(walk)
        for _ in range(LEVELS):
            stay = np.zeros(len(rows), bool)
            for low, high in bands:
                sure = least[(least >= low) & (most <= high)]
                floor = max(low, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else low
                stay |= (most >= floor) & (least <= high)
            rows, least, most = walk.send(stay)
        ids, score = self.ids[rows], products(self.v[rows], q)
        inside = [(score >= low) & (score <= high) for low, high in bands]
        return [first(ids[i], score[i], k) for i in inside]


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def band(positive: int) -> tuple[int, int]:
    """The integers n for which 50 * positive <= 100 * n <= 95 * positive, as least and greatest."""
    return -(-positive // 2), 95 * positive // 100


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        widths = batch["v"].value_lengths().to_numpy(zero_copy_only=False)
        for w in np.unique(widths):
            own = batch.filter(pa.array(widths == w))
            parts = codec(int(w)).encode(matrix(own["v"], own.num_rows))
            lists = [pa.array(list(x.reshape(own.num_rows, -1)), pa.list_(kind)) for x, kind in zip((parts[0].view(np.int64), *parts[1:]), (pa.int64(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*own.columns, *lists], names=[*own.schema.names, "codes", "along", "left"])


_FOUND = ["anchor_id", "akey", "positive_score", "vec_id", "score"]


def _found(rows: list[tuple[int, int, int | None, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    n = [len(r[3]) for r in rows]
    flat = [np.repeat(np.array([r[c] for r in rows], np.int64), n) for c in range(3)]
    flat += [np.concatenate([np.zeros(0, np.int64), *[r[c] for r in rows]]) for c in (3, 4)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flat], names=_FOUND)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3) -> DataFrame:
    """``rows`` (vec_id, label, v: integers): anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    good = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("v").cast("array<bigint>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    good = good.filter("vec_id is not null and label is not null and size(v) > 0")
    once = good.groupBy("vec_id", "label", "v").agg(F.max("asks").alias("asks")).withColumn("key", F.xxhash64("vec_id", "label", "v"))
    kinds = ", ".join(f"{c} {t}" for c, t in once.dtypes)
    points = written(once.mapInArrow(_coded, f"{kinds}, codes array<bigint>, along array<double>, left array<double>").withColumn("bands", F.array().cast("array<bigint>")))
    cols = ["vec_id", "label", "v", "key", "codes", "along", "left", "bands"]
    none = [F.array().cast(t).alias(c) for c, t in (("codes", "array<bigint>"), ("along", "array<double>"), ("left", "array<double>"))]
    anchors = points.filter("asks").select("vec_id", "label", "v", "key", *none, "bands")
    schema = ", ".join(f"{c} bigint" for c in _FOUND)

    def asked(batch: pa.RecordBatch) -> zip:
        return zip(batch["vec_id"].to_pylist(), batch["key"].to_pylist(), batch["label"].to_pylist(), matrix(batch["v"], batch.num_rows), batch["bands"].to_pylist(), strict=True)

    def near(shard: Shard, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield _found([(i, key, 0, *shard.positives(i, label, q, positives)) for i, key, label, q, _ in asked(batch)])

    def hard(shard: Shard, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for i, key, label, q, scores in asked(batch):
            for p, got in zip(scores, shard.negatives(i, label, q, [band(p) for p in scores], negatives), strict=True):
                out.append((i, key, p, *got))
        yield _found(out)

    held, order = points.select(*cols), [F.desc("score"), "vec_id"]
    best = written(top(meet(held, anchors, Shard, near, schema), ["anchor_id", "akey"], order, positives))
    # bands that no integer lies in are left out here; equal positive scores share theirs
    low, high = F.expr("(score + pmod(score, 2)) div 2"), F.expr("(95 * score - pmod(95 * score, 100)) div 100")
    bands = best.filter(low <= high).groupBy(F.col("anchor_id").alias("vec_id"), F.col("akey").alias("key")).agg(F.collect_set("score").alias("bands"))
    wanting = written(anchors.drop("bands").join(bands, ["vec_id", "key"]).select(*cols))
    found = top(meet(held, wanting, Shard, hard, schema), ["anchor_id", "akey", "positive_score"], order, negatives, "rank")
    pairs = best.select("anchor_id", "akey", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = pairs.join(found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}), ["anchor_id", "akey", "positive_score"])
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def labelled(rows: DataFrame, scale: int = 256) -> DataFrame:
    """``rows`` (vec_id, embedding, label) with integer vectors, and the next label where vec_id is divisible by 7."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.filter(finite(F.col("embedding"))).select("vec_id", moved.alias("label"), scaled(F.col("embedding"), scale).alias("v"))


#: The same by brute force. Only for tables in which an id stands on one row.
SQL = """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM pairs WHERE same) WHERE k <= 5)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS k
  FROM positives p JOIN pairs n USING (anchor_id) WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score) WHERE k <= 3"""
