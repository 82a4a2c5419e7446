import numpy as np
from pyspark.sql import functions as F

from claimlake.llm import ann


def brute(rows, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, v)
    ids = sorted(good)
    out = {}
    for q in ids:
        if q % 50 == 0:
            others = [i for i in ids if i != q and len(good[i]) == len(good[q])]
            if others:
                score = ann.cosines(np.array([good[q]] * len(others), np.float64), np.array([good[i] for i in others], np.float64))
                out[q] = sorted(zip(-score, others))[:k]
    return out


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in rows.collect()])
    got = {}
    for r in ann.nearest(rows, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want)
    hit = total = 0
    for q, best in want.items():
        scores = {i: -s for s, i in best}
        assert sorted(got[q]) == list(range(1, len(best) + 1))
        found = [got[q][n] for n in sorted(got[q])]
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hit += sum(i in scores for i, _ in found)
        total += len(best)
        assert all(abs(scores[i] - s) < 1e-12 for i, s in found if i in scores)
    assert hit / total > 0.95


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(200, None), (250, [0.0] * 6), (300, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (350, [float("nan")] * 6), (400, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (450, [])]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(300)] + [(2000, [2.0, 4.0, 6.0, 8.0, 10.0, 12.0])]
    rows += [rows[50]]
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, score string")
    want = brute([(r.vec_id, r.embedding) for r in docs.collect()])
    got = {}
    for r in ann.nearest(docs, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: [i for _, i, _ in sorted(v)] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert ann.nearest(docs.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = docs.filter("vec_id in (0, 1, 2)")
    assert sorted((r.rank, r.vec_id) for r in ann.nearest(few, F.col("vec_id") % 50 == 0).collect()) == sorted((n + 1, i) for n, (_, i) in enumerate(brute(rows[:3])[0]))


def test_ties_go_to_smaller_ids(spark):
    """Vectors that are powers of two of one another are equally near."""
    rows = [(i, [1.0 * 2**i, 2.0 * 2**i, -0.5 * 2**i]) for i in range(30)] + [(100 + i, [1.0, -1.0, i + 1.0]) for i in range(30)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for leaf in (512, 8):
        got = [(r.vec_id, r.rank) for r in ann.nearest(docs, F.col("vec_id") == 0, leaf=leaf, leaves=1000).collect()]
        assert sorted(got) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_parts_of_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(ann, "HELD", 16)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(300)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(docs, F.col("vec_id") % 50 == 0, sample=64, leaf=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in best] for q, best in brute(rows).items()}


def test_leaves_grow_with_the_forest(spark):
    """Trees of 512 leaves, of which a query looks at a share."""
    v = np.random.default_rng(8).normal(size=(6000, 32))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id bigint, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = unit[::50] @ unit.T
    score[np.arange(0, 6000, 50) // 50, np.arange(0, 6000, 50)] = -2
    want = {q * 50: set(np.argsort(-s)[:5].tolist()) for q, s in enumerate(score)}
    hit = sum(r.vec_id in want[r.query_id] for r in ann.nearest(docs, F.col("vec_id") % 50 == 0, leaf=16).collect())
    assert hit / (5 * len(want)) > 0.9


def test_every_width_is_searched(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6 if i % 10 else 4 + i % 3).tolist()) for i in range(600)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(docs, F.col("vec_id") % 50 == 0, sample=200).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in best] for q, best in brute(rows).items()}


def test_very_small_and_very_large_vectors(spark):
    rng = np.random.default_rng(10)
    rows = [(i, (rng.normal(size=6) * 10.0 ** rng.choice([-200, 200])).tolist()) for i in range(60)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(docs, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in best] for q, best in brute(rows).items()}
