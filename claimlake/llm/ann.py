"""Approximate nearest neighbours by a forest of random-projection trees.

Vectors of each width have a forest of their own, as they have no cosine with others.
The trees are built on a bounded sample: a node splits at the median of a projection
on the difference of two sampled vectors. Every vector is indexed, one leaf a tree. A
query walks all trees with one shared priority queue, ordered by the smallest margin
by which its path left a split, until it holds ``share`` of the forest's leaves, and
``leaves`` of them at least. Vectors and queries of a leaf meet in one task, in parts
of bounded size: a part's vectors are held, the queries stream past them, and each
takes its best by exact cosine in double precision.

Equal vectors are one point, held with its smallest ids, as many as a query can need,
and equal queries search once; so neither a vector that many rows share nor its
queries make a large group. A point is known by a hash of its vector, and the hash is
seeded anew until no two points share one.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without an id, take no part; fewer candidates than k give what
there is; ties go to the smaller id, among any number of equally near rows; rows with
an equal id and vector count once; empty tables give none; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Sampled vectors that the trees are built on, at most (a leaf's worth for each width besides), their bytes, and a seed.
SAMPLE, SAMPLE_BYTES, SEED = 100_000, 100_000_000, 11
TREES, LEAF, LEAVES = 10, 512, 48
#: Share of a forest's leaves that a query looks at (README: recall).
SHARE = 0.065
#: Vectors of a leaf that a task holds at once, about.
HELD = 4096


def usable(vector: Column) -> Column:
    """Non-empty, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Tree:
    """Split planes in level order: child numbers below zero are leaves (-1 - leaf)."""

    def __init__(self, sample: np.ndarray, rng: np.random.Generator, leaf: int):
        planes, cuts, left, right = [], [], [], []
        self.leaves = 0

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                for _ in range(4):
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    plane = a - b
                    along = sample[rows] @ plane
                    cut = float(np.median(along))
                    low = along < cut
                    if 0 < low.sum() < len(rows):
                        k = len(planes)
                        planes.append(plane / max(1e-30, float(np.linalg.norm(plane))))
                        cuts.append(cut / max(1e-30, float(np.linalg.norm(plane))))
                        left.append(0)
                        right.append(0)
                        left[k] = grow(rows[low])
                        right[k] = grow(rows[~low])
                        return k
            self.leaves += 1
            return -self.leaves

        self.root = grow(np.arange(len(sample)))
        width = sample.shape[1]
        self.planes = np.array(planes, np.float64).reshape(-1, width)
        self.cuts, self.left, self.right = np.array(cuts), np.array(left, np.int64), np.array(right, np.int64)

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        at = np.full(len(vectors), self.root)
        while (inner := np.nonzero(at >= 0)[0]).size:
            node = at[inner]
            low = np.einsum("ij,ij->i", vectors[inner], self.planes[node]) < self.cuts[node]
            at[inner] = np.where(low, self.left[node], self.right[node])
        return -1 - at


class Forest:
    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees = [Tree(sample, rng, leaf) for _ in range(trees)]
        self.leaves = sum(t.leaves for t in self.trees)

    def search(self, query: np.ndarray, leaves: int) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs nearest by margin, from one queue over all trees."""
        queue = [(0.0, t, tree.root) for t, tree in enumerate(self.trees)]
        heapq.heapify(queue)
        out = []
        while queue and len(out) < leaves:
            margin, t, at = heapq.heappop(queue)
            tree = self.trees[t]
            while at >= 0:
                side = float(query @ tree.planes[at] - tree.cuts[at])
                near, far = (tree.left[at], tree.right[at]) if side < 0 else (tree.right[at], tree.left[at])
                heapq.heappush(queue, (max(margin, abs(side)), t, int(far)))
                at = int(near)
            out.append((t, -1 - at))
        return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; each is scaled first, so that no square of a component is lost."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision, scaled first so that no square overflows."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def closest(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k best rows of ``v`` by cosine, ties by id: (query's number, row's number, score).

    A matrix product picks all rows that rounding could put among the k best, equally
    near ones included; these are compared exactly.
    """
    unit, keep = _unit(v), min(len(v), k)
    who, what, how = [], [], []
    for n in range(0, len(q), 256):
        near = _unit(q[n : n + 256]) @ unit.T
        least = np.partition(near, len(v) - keep, axis=1)[:, len(v) - keep]
        i, row = np.nonzero(near >= least[:, None] - 1e-9)
        score = cosines(q[n + i], v[row])
        order = np.lexsort((ids[row], -score, i))
        i, row, score = i[order], row[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        best = place < k
        who.append(n + i[best])
        what.append(row[best])
        how.append(score[best])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, what, how))


_MET = pa.schema([("qid", pa.int64()), ("pid", pa.int64()), ("score", pa.float64()), ("least", pa.int64())])


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, part, pid, least, qid, v) sorted by cell and part, vectors (without qid) first: each query's best there."""
    now, held, ids = None, [], []
    v = np.zeros((0, 0))
    for b in batches:
        cell, part = (b.column(c).to_numpy() for c in (0, 1))
        edge = np.concatenate([[0], np.nonzero((np.diff(cell) != 0) | (np.diff(part) != 0))[0] + 1, [b.num_rows]]) if b.num_rows else [0]
        for a, z in itertools.pairwise(edge):
            own = b.slice(a, z - a)
            if (cell[a], part[a]) != now:
                now, held, ids, v = (cell[a], part[a]), [], [], np.zeros((0, 0))
            asks = own.column(4).is_valid().to_numpy(zero_copy_only=False)
            flat = lambda rows: rows.column(5).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            if not asks.all():
                mine = own.filter(pa.array(~asks))
                held.append(flat(mine))
                ids.append(np.stack([mine.column(c).to_numpy() for c in (2, 3)], axis=1))
                v = np.zeros((0, 0))
            if asks.any() and held:
                if not len(v):
                    held, ids = [np.concatenate(held)], [np.concatenate(ids)]
                    v = held[0]
                here = own.filter(pa.array(asks))
                who, what, score = closest(flat(here), v, ids[0][:, 1], k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (here.column(4).to_numpy()[who], ids[0][what, 0], score, ids[0][what, 1])], schema=_MET)


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    trees: int = TREES,
    leaf: int = LEAF,
    leaves: int = LEAVES,
    sample: int = SAMPLE,
    share: float = SHARE,
) -> DataFrame:
    """``rows`` (vec_id, embedding): query_id, rank, vec_id, score of the k nearest rows found for each query row."""
    spark = rows.sparkSession
    good = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    good = good.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    # one point for equal vectors of one width; a query needs k others at most, so k + 1 ids serve
    near = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    salted = good.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(near.alias("ids"), F.max("asks").alias("asks"))
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    for seed in itertools.count():
        pid = F.xxhash64(F.lit(seed), "v").alias("pid")
        points = written(salted.groupBy("v").agg(ids.alias("ids"), F.max("asks").alias("asks")).select("v", "ids", "asks", pid, F.xxhash64("v").alias("draw")))
        total, known = points.agg(F.count("*"), F.countDistinct("pid")).first()
        if total == known:
            break
    counts = dict(points.groupBy(F.size("v").alias("w")).count().collect())
    if not counts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # the lowest values of another hash are a sample, of every width as large as its share of the points or a leaf
    most = min(sample, max(leaf, SAMPLE_BYTES * total // (8 * sum(w * n for w, n in counts.items()))))
    rates = {w: max(most / total, leaf / n) for w, n in counts.items()}
    lowest = [(w, (1 << 63) - 1 if r >= 1 else int((r - 0.5) * (1 << 64))) for w, r in rates.items()]
    limits = F.broadcast(spark.createDataFrame(lowest, "w int, most bigint"))
    picked = points.join(limits, F.size("v") == F.col("w")).filter(F.col("draw") <= F.col("most")).select("pid", "v").toArrow()
    picked = picked.sort_by("pid").column("v").combine_chunks()
    widths = picked.value_lengths().to_numpy(zero_copy_only=False)

    def grown(w: int) -> Forest:
        chosen = picked.filter(pa.array(widths == w)).flatten().to_numpy(zero_copy_only=False).reshape(-1, w)
        return Forest(_unit(chosen), trees, leaf)

    forest = spark.sparkContext.broadcast({w: grown(w) for w in counts})

    # vectors beyond the sample make leaves larger, so a leaf is dealt out in parts
    parts = max(1, -(-total * leaf // (most * HELD)))

    def by_width(f: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
        return iter(f.groupby(f["v"].map(len).to_numpy()))

    def names(w: int, pairs: list[tuple[int, int]]) -> list[int]:
        """Cells of (tree, leaf) pairs, apart for each width."""
        return [(w << 42) + (t << 32) + x for t, x in pairs]

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for w, own in by_width(f):
                for n in range(0, len(own), 2048):
                    p = own.iloc[n : n + 2048]
                    unit = _unit(np.array(p["v"].tolist(), np.float64))
                    cells = np.stack([tree.leaf(unit) + names(w, [(t, 0)])[0] for t, tree in enumerate(forest.value[w].trees)], axis=1)
                    yield p.assign(cells=list(cells))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for w, own in by_width(f):
                woods = forest.value[w]
                wanted = max(leaves, math.ceil(share * woods.leaves))
                unit = _unit(np.array(own["v"].tolist(), np.float64))
                yield own.assign(cells=[np.array(names(w, woods.search(u, wanted)), np.int64) for u in unit])

    part = F.pmod(F.col("pid"), F.lit(parts)).cast("bigint").alias("part")
    none = F.lit(None).cast("bigint")
    held = points.select("pid", F.get("ids", F.lit(0)).alias("least"), "v").mapInPandas(index, "pid bigint, least bigint, v array<double>, cells array<bigint>")
    held = held.select(F.explode("cells").alias("cell"), part, "pid", "least", none.alias("qid"), "v")
    sent = points.filter("asks").select("pid", "v").mapInPandas(ask, "pid bigint, v array<double>, cells array<bigint>")
    sent = sent.select(F.explode("cells").alias("cell"), "pid", "v").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"), "pid", none.alias("least"), F.col("pid").alias("qid"), "v"
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = held.unionByName(sent).repartition(n, "cell", "part").sortWithinPartitions("cell", "part", F.col("qid").asc_nulls_first())
    scored = both.mapInArrow(lambda b: _meet(b, k + 1), "qid bigint, pid bigint, score double, least bigint")
    scored = scored.groupBy("qid", "pid").agg(F.max("score").alias("score"), F.max("least").alias("least"))  # a pair that meets in several leaves has one score
    # k + 1 points in this order hold the k best rows, whatever further ids they have
    best = top(scored, "qid", [F.desc("score"), "least"], k + 1)
    found = best.join(points.select("pid", "ids"), "pid").select("qid", "score", F.explode("ids").alias("vec_id"))
    asked = good.filter("asks").select(F.col("vec_id").alias("query_id"), F.xxhash64(F.lit(seed), "v").alias("qid")).distinct()
    named = asked.join(found, "qid").filter("query_id != vec_id")
    return top(named, "query_id", [F.desc("score"), "vec_id"], k, "rank").select("query_id", "rank", "vec_id", "score")


def top(rows: DataFrame, key: str, order: list, k: int, rank: str = "_n") -> DataFrame:
    """The first k rows of each key; Spark keeps k a task before the shuffle."""
    from pyspark.sql import Window

    out = rows.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(rank) <= k)
    return out if rank != "_n" else out.drop(rank)
