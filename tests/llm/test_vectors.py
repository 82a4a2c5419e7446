"""Exact top-k, hard negatives and whitening against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlake.llm import blocks, negatives, topk, whitening

def each_50():
    return F.col("vec_id") % 50 == 0
WIDE = "vec_id bigint, embedding array<double>, label int, score string, key int"


def odd_rows():
    """Nulls, non-finite and empty vectors, ties, repeated rows, two widths, zero vectors."""
    rng = np.random.default_rng(3)
    rows = [(i, np.round(rng.normal(size=6), 1).tolist(), i % 3) for i in range(300)]
    rows += [(i, rng.normal(size=4).tolist(), 0) for i in range(450, 560, 5)]
    rows += [(600, None, 1), (650, [], 1), (700, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (750, [float("nan")] * 6, 2), (None, [1.0] * 6, 1), (800, [0.0] * 6, 1), (850, [0.5] * 6, None)]
    rows += [(900 + i, [0.25, -0.5, 1.0, 0.0, 0.0, 0.0], i % 2) for i in range(100)] + rows[100:140]
    return [(*r, "x", 1) for r in rows]


def usable(rows):
    return sorted({(i, tuple(int(np.floor(256 * x)) for x in v), y) for i, v, y, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}, key=lambda r: r[0])


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, k=5):
    good = usable(rows)
    out = set()
    for i, v, _ in good:
        if i % 50 == 0:
            best = sorted((-product(v, w), j) for j, w, _ in good if j != i and len(w) == len(v))[:k]
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(best, 1)}
    return out


def brute_mined(rows):
    good = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in usable(rows) if y is not None]
    out = set()
    for i, v, y in good:
        if i % 50 == 0:
            scored = sorted((-product(v, w), j, z == y) for j, w, z in good if j != i and len(w) == len(v))
            for p, j in [(-s, j) for s, j, same in scored if same][:5]:
                hard = [(-s, m) for s, m, same in scored if not same and 50 * p <= -100 * s <= 95 * p][:3]
                out |= {(i, j, n, m, p, s) for n, (s, m) in enumerate(hard, 1)}
    return out


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(blocks, "SHARD", 64)
    monkeypatch.setattr(blocks, "BLOCK", 4)


def test_top_is_exact(spark, small_shards):
    rows = odd_rows()
    df = spark.createDataFrame(rows, WIDE)
    got = [tuple(r) for r in topk.exact_top(df, each_50()).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_top(rows)
    assert topk.exact_top(df.limit(0), each_50()).count() == 0
    few = df.filter("vec_id in (0, 1, 2)")
    assert {tuple(r) for r in topk.exact_top(few, each_50()).collect()} == brute_top(rows[:3])


def test_top_stops_early_where_it_may():
    """One long component decides: the lists end long before the rows do."""
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, size=(5000, 8))
    v[:, 2] = rng.integers(-10_000, 10_000, size=5000)
    q = np.array([0, 1, -9, 0, 0, 1, 0, 0])
    rows, scores, scored = topk.Lists(np.arange(5000), v).best(-1, q, 5)
    assert scored < 500
    order = np.lexsort((np.arange(5000), -(v @ q)))[:5]
    assert rows.tolist() == order.tolist() and scores.tolist() == (v @ q)[order].tolist()


def test_ids_on_several_vectors(spark):
    """A query with an id that stands on two rows: each has its own neighbours, and none is its own."""
    rows = [(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)]
    got = sorted((r.rank, r.vec_id) for r in topk.exact_top(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), each_50(), k=1).collect())
    assert got == [(1, 1), (1, 2)]


def test_large_components():
    v = np.array([[1 << 30, -(1 << 30)], [1 << 29, 5]])
    assert blocks.products(v, v[0]).tolist() == [1 << 61, (1 << 59) - 5 * (1 << 30)]
    with pytest.raises(OverflowError):
        blocks.products(v << 3, v[0] << 3)


def test_mined_negatives_are_exact(spark, small_shards):
    rows = odd_rows()
    df = spark.createDataFrame(rows, WIDE)
    got = [tuple(r) for r in negatives.mine(negatives.labelled(df), each_50()).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_mined(rows)
    assert negatives.mine(negatives.labelled(df.limit(0)), each_50()).count() == 0


@pytest.mark.parametrize("width", [1, 3, 64, 100])
def test_intervals_hold_the_score(width):
    rng = np.random.default_rng(width)
    v = rng.integers(-256, 257, size=(500, width))
    v[:5] = 0
    tool = negatives.Codec(width)
    shard = negatives.Shard.__new__(negatives.Shard)
    shard.v, shard.norm = v, np.sqrt((v.astype(float) ** 2).sum(axis=1))
    shard.codes, shard.along, shard.left = tool.encode(v)
    for q in (*v[:20], *rng.integers(-256, 257, size=(10, width))):
        walk = shard.levels(q, np.arange(500))
        widths = []
        rows, least, most = next(walk)
        for _ in range(negatives.LEVELS):
            assert (least <= v @ q).all() and (v @ q <= most).all() or np.isinf(least).all()
            widths.append((most - least).mean())
            rows, least, most = walk.send(np.ones(len(rows), bool))
        assert widths == sorted(widths, reverse=True)


def test_codes_spare_most_scores(spark):
    """What the intervals leave for integer scores is a small part of the rows."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    v = np.floor(256 * np.array(e["embedding"].tolist())).astype(np.int64)
    shard = negatives.Shard.__new__(negatives.Shard)
    shard.v, shard.norm, shard.ids, shard.labels = v, np.sqrt((v.astype(float) ** 2).sum(axis=1)), e["vec_id"].to_numpy(), np.zeros(len(v))
    shard.codes, shard.along, shard.left = negatives.Codec(64).encode(v)
    for q in range(0, 200, 20):
        walk = shard.levels(v[q], np.nonzero(shard.ids != shard.ids[q])[0])
        rows, least, most = next(walk)
        for _ in range(negatives.LEVELS):
            rows, least, most = walk.send(most >= np.partition(least, len(rows) - 5)[len(rows) - 5])
        assert len(rows) < 200


@pytest.mark.parametrize("p", [-101, -100, -3, -1, 0, 1, 2, 3, 99, 100, 101])
def test_band(p):
    low, high = negatives.band(p)
    assert [n for n in range(-200, 201) if 50 * p <= 100 * n <= 95 * p] == list(range(low, high + 1))


def brute_whitened(rows, k=16):
    """By width: ids, deviations, whitened coordinates, shares."""
    good = [(i, np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000) for i, v, *_ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for w in {len(x) for _, x in good}:
        ids, x = [i for i, y in good if len(y) == w], np.array([y for _, y in good if len(y) == w])
        once = np.unique(x, axis=0)
        n, s = len(once), once.sum(axis=0)
        c = (n * once - s) / n
        e, u = np.linalg.eigh(c.T @ c / n)
        e, u = e[::-1][:k], u[:, ::-1][:, :k]
        keep = e > 1e-12 * np.trace(c.T @ c / n)
        out[w] = ids, ((n * x - s) ** 2).sum(axis=1), ((n * x - s) / n) @ u[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(c.T @ c / n), n
    return out


def check_whitened(got, rows):
    for ids, deviation, white, share, n in brute_whitened(rows).values():
        own = [r for r in got if r.n == n]
        assert len(own) == len(ids) * len(share)
        by = {}
        for r in own:
            by.setdefault(r.component, []).append(r)
        for c, of in by.items():
            want = sorted(zip([-1 if i is None else i for i in ids], deviation.tolist(), white[:, c - 1]))
            for sign in (1, -1):
                have = sorted((-1 if r.vec_id is None else r.vec_id, r.deviation, sign * r.whitened) for r in of)
                if all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-8 for a, b in zip(have, want, strict=True)):
                    break
            else:
                raise AssertionError(c)
            assert all(abs(r.explained / share[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in of)


def test_whitened_rows(spark):
    rows = [r for r in odd_rows() if r[0] not in (650,)]
    df = spark.createDataFrame(rows, WIDE)
    check_whitened(whitening.whiten(df).collect(), rows)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 1")).count() == 0
    # a component without variance has no row
    flat = [(i, [float(i % 7), 2.0, float(i % 5)], 0, "x", 1) for i in range(80)]
    got = whitening.whiten(spark.createDataFrame(flat, WIDE)).collect()
    assert {r.component for r in got} == {1, 2}
    check_whitened(got, flat)


def test_whitened_by_filter(spark):
    """Wider than the block, so that rounds are needed."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    check_whitened(whitening.whiten(e).collect(), rows)


def test_deviations_are_exact():
    n, x = 3_000_000_000, np.array([[1 << 20, (1 << 20) + 1], [1 << 20, 1 << 20]])
    sums = np.array([n << 20, (n << 20) + 1])
    assert whitening.deviations(x, n, sums) == [(n - 1) ** 2, 1]
