"""Interval joins and prefix scans against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimlake.operators import dedup, ranges, scan

T = datetime(2024, 1, 1)
ROWS = "id int, valid_from timestamp, valid_until timestamp, recorded_at timestamp, superseded_at timestamp"
PROBES = "probe_id int, valid_at timestamp, known_at timestamp"


def intervals(rng, n):
    """Lengths from a microsecond to forever, many of them equal, some empty or null."""
    out = []
    for k in range(n):
        times = []
        for _ in range(2):
            a = T + timedelta(microseconds=rng.choice([0, 5, rng.randint(0, 10**9), rng.randint(0, 10**12)]))
            z = None if rng.random() < 0.1 else a + timedelta(microseconds=rng.choice([0, 1, rng.randint(1, 10**4), rng.randint(1, 10**8), rng.randint(1, 10**12)]))
            times += [None if rng.random() < 0.03 else a, z]
        out.append((k, *times))
    return out


def brute(rows, probes):
    inside = lambda a, z, t: a is not None and t is not None and a <= t and (z is None or t < z)
    return {(r[0], p[0]) for r in rows for p in probes if inside(r[1], r[2], p[1]) and inside(r[3], r[4], p[2])}


@pytest.mark.parametrize("pairs", [ranges.PAIRS, 50])
def test_known_at_by_bins(spark, monkeypatch, pairs):
    monkeypatch.setattr(dedup, "PROBES", 10)
    monkeypatch.setattr(ranges, "PAIRS", pairs)
    rng = random.Random(4)
    rows = intervals(rng, 300) + [(1000 + k, T, None, T, None) for k in range(60)]
    probes = [(k, T + timedelta(microseconds=rng.randint(0, 10**12)), T + timedelta(microseconds=rng.choice([5, rng.randint(0, 10**12)]))) for k in range(80)]
    probes += [(100 + k, T + timedelta(microseconds=5), T + timedelta(microseconds=6)) for k in range(30)] + [(200, None, T), (201, T, None)]
    a, b = spark.createDataFrame(rows, ROWS), spark.createDataFrame(probes, PROBES)
    got = [(r.id, r.probe_id) for r in dedup.known_at(a, b).select("id", "probe_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, probes)
    assert dedup.known_at(a.limit(0), b).count() == 0
    assert ranges.stab(a, b.limit(0), [ranges.Axis("valid_from", "valid_until", "valid_at")]).count() == 0


def test_bins_meet_by_equal_keys(spark):
    a = spark.createDataFrame(intervals(random.Random(1), 50), ROWS)
    b = spark.createDataFrame([(k, T + timedelta(seconds=k), T) for k in range(50)], PROBES)
    plan = ranges.stab(a, b, [ranges.Axis("valid_from", "valid_until", "valid_at")])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def scanned(rows, how, own):
    out, totals = {}, {}
    for key, at, n, value in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        before = totals.get(key)
        after = value if before is None else before if value is None else before + value if how == "sum" else max(before, value)
        totals[key] = after
        out[n] = after if own else before
    return out


@pytest.mark.parametrize("how", ["sum", "max"])
@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("largest", [10, 1_000_000])
def test_running(spark, how, own, largest):
    """One key holds most rows; null keys and values; equal instants."""
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randint(0, 40), n, rng.choice([None, rng.randint(-9, 9)])) for n in range(500)]
    df = spark.createDataFrame(rows, "key string, at int, n int, value bigint")
    got = {r.n: r.x for r in scan.running(df, ["key"], ["at", "n"], "value", how, "x", own, largest).collect()}
    assert got == scanned(rows, how, own)
    assert scan.running(df.limit(0), ["key"], ["at", "n"], "value", how, "x", own, largest).count() == 0


def test_a_hot_key_spreads(spark):
    df = spark.range(4000).select(F.lit("k").alias("key"), F.col("id").alias("at"), F.lit(1).alias("value"))
    out = scan.running(df, ["key"], ["at"], "value", "sum", "x", largest=100)
    assert out.filter("x != at + 1").count() == 0
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1500


@pytest.mark.parametrize("largest", [20, 1_000_000])
def test_trailing_count(spark, largest):
    rng = random.Random(8)
    rows = [(n, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, rng.randint(0, 300)])) for n in range(300)]
    df = spark.createDataFrame(rows, "id int, key string, us bigint")
    got = {r.id: r.n for r in scan.trailing_count(df, "key", "us", 25, largest=largest).collect()}
    want = {i: 0 if t is None else sum(k2 == k and t2 is not None and t - 25 < t2 <= t for _, k2, t2 in rows) for i, k, t in rows}
    assert got == want


@pytest.mark.parametrize("largest", [5, 1_000_000])
def test_overlaps_on_a_hot_key(spark, monkeypatch, largest):
    monkeypatch.setattr(scan.running, "__defaults__", ("sum", "running", True, largest))
    rng = random.Random(9)
    rows = [(n, "k" if n % 5 else f"x{n % 3}", T + timedelta(hours=rng.randint(0, 200)), None if rng.random() < 0.05 else 1) for n in range(80)]
    rows = [(n, k, a, a + timedelta(hours=2) if z else None) for n, k, a, z in rows]
    df = spark.createDataFrame(rows, "id int, key string, valid_from timestamp, valid_until timestamp")
    far = datetime(9999, 12, 31)
    want = {n for n, k, a, _ in rows if any(k2 == k and (a2, m) < (a, n) and (z2 or far) > a for m, k2, a2, z2 in rows)}
    assert {r.id for r in dedup.valid_time_overlaps(df, "key").collect()} == want


@pytest.mark.parametrize("stretch", [ranges.STRETCH, 7])
def test_tally_makes_no_pairs(spark, monkeypatch, stretch):
    """Against brute force: with instants that many rows, or many probes, share and so fill stretches of their own."""
    monkeypatch.setattr(ranges, "STRETCH", stretch)
    rng = random.Random(5)
    five = T + timedelta(microseconds=5)
    rows = intervals(rng, 300) + [(1000 + k, T, None, T, None) for k in range(60)]
    probes = [(k, T + timedelta(microseconds=rng.randint(0, 10**12)), T + timedelta(microseconds=rng.choice([5, rng.randint(0, 10**12)]))) for k in range(80)]
    probes += [(100 + k, five, T + timedelta(microseconds=6)) for k in range(60)] + [(200, None, T), (201, T, None), (202, T - timedelta(days=1), T)]
    a, b = spark.createDataFrame(rows, ROWS), spark.createDataFrame(probes, PROBES)
    found = dedup.known_tally(a, b, "id", "probe_id")
    want = {}
    for row, probe in brute(rows, probes):
        n, first = want.get(probe, (0, row))
        want[probe] = n + 1, min(first, row)
    assert {r.probe_id: (r.n, r.first) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    assert dedup.known_tally(a.limit(0), b, "id", "probe_id").count() == dedup.known_tally(a, b.limit(0), "id", "probe_id").count() == 0
