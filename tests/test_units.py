"""Tables that change as one unit, and the streams that write them."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from claimlake.operators import dedup
from claimlake.sources import units
from claimlake.streaming import seeds, survivors

CLAIM = "id string, statement_sha256 string, recorded_at timestamp, superseded_at timestamp"
DAY = datetime(2024, 5, 1)


def test_a_batch_is_there_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "u")
    with pytest.raises(ValueError):
        units.read(spark, root, "a")
    assert units.read(spark, root, "a", "id bigint").count() == 0
    one = {"a": units.Change(spark.range(3)), "b": units.Change(spark.range(2), "replace")}
    assert units.commit(spark, root, 0, one) and not units.commit(spark, root, 0, one)
    bad = {"a": units.Change(spark.range(5)), "b": units.Change(spark.range(9).select(F.raise_error(F.lit("killed")).cast("bigint").alias("id")))}
    with pytest.raises(Exception, match="killed"):
        units.commit(spark, root, 1, bad)
    assert units.read(spark, root, "a").count() == 3 and list(units.manifests(spark, root)) == [0]
    assert units.commit(spark, root, 1, {"a": units.Change(spark.range(5)), "b": units.Change(spark.range(7), "replace")})
    assert units.read(spark, root, "a").count() == 8 and units.read(spark, root, "b").count() == 7
    assert units.read(spark, root, "b", before=1).count() == 2
    gone = units.sweep(spark, root)
    assert sorted(g.split("/")[1] for g in gone) == ["a", "b", "b"]
    assert units.read(spark, root, "a").count() == 8 and units.read(spark, root, "b").count() == 7


def test_buckets(spark, tmp_path):
    root = str(tmp_path / "u")
    rows = spark.range(100).withColumn("_bucket", units.bucket_of(8, "id"))
    units.commit(spark, root, 0, {"t": units.Change(rows, "buckets", tuple(range(8)))})
    before = units.places(spark, root, "t")[1]
    units.commit(spark, root, 1, {"t": units.Change(rows.filter("_bucket = 3 and id < 50"), "buckets", (3, 4))})
    after = units.places(spark, root, "t")[1]
    assert {b for b in range(8) if before[b] != after[b]} == {3, 4}
    want = {r.id for r in rows.collect() if r._bucket not in (3, 4) or r._bucket == 3 and r.id < 50}
    assert {r.id for r in units.read(spark, root, "t").collect()} == want
    assert units.read(spark, root, "t", only=[4]).count() == 0


def survivors_by_batch(batches, known=()):
    """Brute force: (id, successor, closed) after each batch."""
    live = {}
    for i, h, t in known:
        live.setdefault(h, []).append((t, i))
    best, out = {h: min(v) for h, v in live.items()}, set()
    for rows in batches:
        latest = max(t for *_, t in rows)
        for h in {h for _, h, _ in rows}:
            mine = [(t, i) for i, g, t in rows if g == h]
            all_of = mine + ([best[h]] if h in best else [])
            best[h] = min(all_of)
            out |= {(i, best[h][1], max(latest, t, best[h][0]) + timedelta(microseconds=1)) for t, i in all_of if (t, i) != best[h]}
    return out


def run_closures(spark, tmp_path, batches, known=None, fail_at=None):
    for k, rows in enumerate(batches):
        at = tmp_path / f"in/{k}"
        if not at.exists():
            spark.createDataFrame([(i, h, t, None) for i, h, t in rows], CLAIM).coalesce(1).write.parquet(str(at))
            for f in at.glob("*.parquet"):
                os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    root, tries = str(tmp_path / "u"), []

    def write(df, n):
        tries.append(n)
        if n == fail_at and tries.count(n) == 1:
            raise OSError("gone for a moment")
        units.commit(spark, root, n, {"closures": units.Change(df)})

    def once():
        stream = spark.readStream.schema(CLAIM).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        survivors.stream_closures(stream, write, str(tmp_path / "cp"), known).awaitTermination(200)

    if fail_at is not None:
        with pytest.raises(StreamingQueryException):
            once()
    once()
    return {(r.id, r.successor, r["at"]) for r in units.read(spark, root, "closures").collect()}


def test_closures_by_state_with_a_restart(spark, tmp_path):
    """One statement has most rows; claims come late; batch 1 fails once and runs again from the checkpoint."""
    rng = random.Random(2)
    rows = [(f"c{n:03}", "hot" if n % 3 else f"h{rng.randint(0, 30)}", DAY + timedelta(minutes=rng.randint(0, 10_000))) for n in range(300)]
    batches = [rows[:120], rows[120:220], rows[220:]]
    assert run_closures(spark, tmp_path, batches, fail_at=1) == survivors_by_batch(batches)


def test_closures_know_what_was_before(spark, tmp_path):
    known = [("k1", "h", DAY), ("k2", "g", DAY + timedelta(days=9))]
    frame = spark.createDataFrame([(i, h, t, None) for i, h, t in known] + [("dead", "z", DAY, DAY + timedelta(days=1)), ("bare", None, DAY, None)], CLAIM)
    batches = [[("a", "h", DAY + timedelta(days=1)), ("b", "g", DAY + timedelta(days=2)), ("c", "z", DAY + timedelta(days=3)), ("d", "z", DAY + timedelta(days=3))]]
    got = run_closures(spark, tmp_path, batches, frame)
    assert {(i, s) for i, s, _ in got} == {("a", "k1"), ("k2", "b"), ("d", "c")} and got == survivors_by_batch(batches, known)


def test_closures_in_order_equal_the_batch_job(spark, tmp_path):
    rows = [(f"c{n:03}", f"h{n % 7}", DAY + timedelta(minutes=n)) for n in range(60)]
    got = run_closures(spark, tmp_path, [rows[:25], rows[25:]])
    pairs = dedup.duplicate_groups(spark.createDataFrame([(i, h, t, None) for i, h, t in rows], CLAIM)).filter("id != survivor")
    assert {(i, s) for i, s, _ in got} == {(r.id, r.survivor) for r in pairs.collect()}


def test_seeding_leaves_other_buckets_alone(spark, tmp_path):
    schema = "repo string, path string, ordinal int, content_sha256 string, statement string, ts timestamp"
    first = [("r", f"p{n}", k, f"{n}-{k}", "s", DAY) for n in range(30) for k in range(2)]
    second = [("r", "p7", 0, "new", "t", DAY + timedelta(days=1)), ("r", "p7", 0, "older", "t", DAY), ("r", "p7", 1, "7-1", "s", DAY + timedelta(days=1))]
    root, places = str(tmp_path / "u"), []
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        seeds.stream_seed_buckets(stream, root, str(tmp_path / "cp"), buckets=16).awaitTermination(200)
        places.append(units.places(spark, root, "live")[1])
    assert sum(places[0].get(b) != places[1][b] for b in places[1]) == 1
    live = {(r.path, r.ordinal): r for r in units.read(spark, root, "live").collect()}
    assert len(live) == 60 and live["p7", 0].content_sha256 == "new" and live["p7", 1].recorded_at == DAY
    closed = units.read(spark, root, "closed").collect()
    assert [(r.path, r.content_sha256, r.superseded_at, r.superseded_by) for r in closed] == [("p7", "7-0", DAY + timedelta(days=1), live["p7", 0].id)]


def test_statements_share_rows_of_state(spark, tmp_path):
    """A row of state, and what it costs a batch, is a group's and no statement's; the second part brings earlier claims of half of them."""
    rows = [(f"c{n:05}", f"h{n % 3000}", DAY + timedelta(minutes=(n * 37) % 4500)) for n in range(4500)]
    of = lambda part: spark.createDataFrame([(*r, None) for r in part], CLAIM)
    got = []
    for part in (rows[:3000], rows[3000:]):
        of(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(CLAIM).parquet(f"{tmp_path}/in")
        run = survivors.stream_closures(stream, lambda df, n: got.extend((r.id, r.successor, r["at"]) for r in df.collect()), f"{tmp_path}/cp")
        run.awaitTermination(200)
        batch = max(run.recentProgress, key=lambda p: p["numInputRows"])
        assert 0 < batch["stateOperators"][0]["numRowsTotal"] <= survivors.GROUPS
    assert len(got) == 1500 and set(got) == survivors_by_batch([rows[:3000], rows[3000:]])
