import os
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException

from claimlake.functions.limits import LOGIN, LimitConfig
from claimlake.operators import quota
from claimlake.schemas import SCHEMAS
from claimlake.sources.docs import capture_source
from claimlake.streaming import jobs, survivors

EVENTS = "event_id bigint, principal_id string, ts timestamp, calls bigint, tokens bigint"


def test_quota_stream_equals_batch(spark, tmp_path):
    cfg = LimitConfig(contribution_quota=2, contribution_window=timedelta(seconds=10), cost_window=timedelta(seconds=10))
    rows = [(k, f"p{k % 2}", datetime(2024, 1, 1) + timedelta(seconds=k), 1, 5) for k in range(40)]
    for part in range(2):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = jobs.stream_quota(stream, cfg).writeStream.format("memory").queryName("gate").trigger(availableNow=True)
        q.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.event_id: r.denied_reason for r in spark.table("gate").collect()}
    want = {r.event_id: r.denied_reason for r in quota.replay_admission(spark.createDataFrame(rows, EVENTS), cfg).collect()}
    assert got == want and len(got) == 40


def test_usage_stream(spark, tmp_path):
    schema = "kind string, scope_kind string, scope_value string, inference_calls int, input_tokens int, output_tokens int, recorded_at timestamp"
    rows = [("inference", "path", "a", 1, 10, 1, datetime(2024, 1, 1, 0, m)) for m in range(0, 60, 7)] + [("recall", "path", "a", 0, 0, 0, datetime(2024, 1, 1))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = jobs.stream_usage(stream).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    got = {r.start: r.calls for r in spark.table("usage").collect()}
    want = {}
    for r in rows[:-1]:
        for k in range(4):
            start = datetime(2024, 1, 1) + timedelta(minutes=15 * (r[6].minute // 15 - k))
            want[start] = want.get(start, 0) + 1
    assert got == want


class Kept:
    """Tables by batch number, as a writer of snapshots keeps them."""

    def __init__(self, spark):
        self.spark, self.rows, self.schemas = spark, {}, {}

    def write(self, name, df, n):
        self.rows[name, n], self.schemas[name] = df.collect(), df.schema

    def before(self, name, n, schema, all_batches=False):
        found = sorted(k for m, k in self.rows if m == name and k < n)
        rows = [r for k in (found if all_batches else found[-1:]) for r in self.rows[name, k]]
        return self.spark.createDataFrame(rows, self.schemas.get(name, schema))


CHUNKS = "repo string, path string, ordinal int, content_sha256 string, statement string, ts timestamp"


def test_seed_stream_closes_rows_of_2024(spark, tmp_path):
    day = lambda d: datetime(2024, 3, d)
    batches = [[("r", "p", 0, "a", "s", day(1)), ("r", "p", 1, "b", "s", day(1))], [("r", "p", 0, "c", "t", day(2)), ("r", "p", 0, "old", "u", day(1))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        for f in (tmp_path / f"in/{k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    kept, schema = Kept(spark), "repo string, path string, ordinal int, content_sha256 string, statement string, id string"

    def live(n):
        return kept.before("live", n, schema).filter("superseded_at is null").select(*[c.split()[0] for c in schema.split(", ")]) if n else kept.before("live", n, schema)

    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    jobs.stream_seed(stream, live, lambda df, n: kept.write("live", df, n), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.action for r in kept.rows["live", 0]) == ["inserted", "inserted"]
    last = {(r.ordinal, r.content_sha256): r for r in kept.rows["live", 1]}
    assert {k: r.action for k, r in last.items()} == {(0, "a"): "superseded", (0, "c"): "inserted", (1, "b"): "vanished"}
    assert last[0, "a"].superseded_at == day(2) and last[0, "a"].superseded_by == last[0, "c"].id


def claim_rows(spark, rows):
    columns = [c.split()[0] for c in SCHEMAS["claims"].split(", ")]
    return spark.createDataFrame([tuple({"superseded_at": None, **r}.get(c) for c in columns) for r in rows], SCHEMAS["claims"])


def test_dedup_stream(spark, tmp_path):
    at = datetime(2024, 5, 1)
    old = claim_rows(spark, [{"id": "a", "statement_sha256": "h", "valid_from": at, "recorded_at": at, "confidence": 0.5}])
    new = [{"id": x, "statement_sha256": h, "valid_from": at + timedelta(days=1), "recorded_at": at + timedelta(days=1), "confidence": 0.5} for x, h in (("b", "h"), ("c", "k"))]
    claim_rows(spark, new).coalesce(1).write.parquet(str(tmp_path / "in"))
    kept = Kept(spark)
    stream = spark.readStream.schema(SCHEMAS["claims"]).parquet(str(tmp_path / "in"))
    jobs.stream_dedup(stream, lambda n: old, lambda df, n: kept.write("claims", df, n), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.id: r for r in kept.rows["claims", 0]}
    assert got["b"].superseded_by == "a" and got["b"].superseded_at > got["b"].recorded_at
    assert got["a"].superseded_at is None and got["c"].superseded_at is None


def test_capture_stream_shares_one_quota_and_closes_duplicates(spark, tmp_path):
    line = '{"job_id": "j%d", "source": "# title\\n%s\\n", "repo": "r", "path": "a%d.md", "principals": ["p"], "ts": "2024-01-01T00:00:0%d"}\n'
    for k, (n, words) in enumerate(((1, "same words here"), (2, "other words"), (3, "same words here"), (4, "never admitted"))):
        (tmp_path / f"cap/{k}").mkdir(parents=True)
        (tmp_path / f"cap/{k}/x.json").write_text(line % (n, words, n, n))
        os.utime(tmp_path / f"cap/{k}/x.json", (1_700_000_000 + k, 1_700_000_000 + k))
    kept, live = Kept(spark), datetime(2023, 12, 1)
    base = claim_rows(spark, [{"id": f"old{k}", "statement_sha256": "same", "valid_from": live, "recorded_at": live + timedelta(days=k), "confidence": 0.5, "scope_kind": "path", "scope_value": "s"} for k in range(2)])

    def write(tables, n):
        for name, df in tables.items():
            kept.write(name, df, n)

    cfg = LimitConfig(contribution_quota=3)
    captures = capture_source(spark, str(tmp_path / "cap/*"), streaming=True, files_a_batch=1)
    admitted = "principal_id string, ts timestamp, calls int, tokens int"
    claims = lambda n: kept.before("snapshot", n, SCHEMAS["claims"]) if any(m == "snapshot" for m, _ in kept.rows) else base
    jobs.stream_capture(captures, cfg, claims, lambda n: kept.before("admitted", n, admitted, True), write, str(tmp_path / "cp")).awaitTermination(300)
    assert [len(kept.rows["denied", n]) for n in range(4)] == [0, 0, 0, 1]
    end = kept.rows["snapshot", 3]
    reasons = sorted((r.statement or r.id, r.supersede_reason or "") for r in end)
    assert reasons == [("old0", ""), ("old1", "duplicate"), ("other words", ""), ("same words here", ""), ("same words here", "duplicate")]
    assert all(r.superseded_at > r.recorded_at for r in end if r.superseded_at)


def test_retries(spark, tmp_path):
    schema, tries = "id bigint", []
    spark.range(3).write.parquet(str(tmp_path / "in"))

    def start(fail):
        def step(batch, n):
            tries.append(n)
            if len(tries) <= fail:
                raise OSError("gone for a moment")
            batch.count()

        return lambda: jobs._run(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / f"cp{fail}"), step)

    jobs.with_retries(start(2), wait=0.01)
    assert tries == [0, 0, 0]
    tries.clear()
    with pytest.raises(StreamingQueryException):
        jobs.with_retries(start(9), attempts=2, wait=0.01)
    assert len(tries) == 2


def run_gate(spark, tmp_path, rows, schema, gate):
    """Rows in two files, one a batch, through a gate; what was decided by event."""
    for part in range(2):
        half = len(rows) // 2
        spark.createDataFrame(rows[part * half : (part + 1) * half if not part else None], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = gate(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        with survivors.state_store(spark):
            q = stream.writeStream.option("path", str(tmp_path / "out")).format("parquet").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination(200)
    return {r.event_id: r.denied_reason for r in spark.read.parquet(str(tmp_path / "out")).collect()}


@pytest.mark.parametrize("late", [None, "5 seconds"])
def test_two_windows_and_events_without_a_principal(spark, tmp_path, late):
    cfg = LimitConfig(contribution_quota=3, contribution_window=timedelta(seconds=20), max_inference_calls=2, max_input_tokens=0, cost_window=timedelta(seconds=5))
    rows = [(k, None if k % 5 == 0 else "" if k % 7 == 0 else f"p{k % 2}", datetime(2024, 1, 1) + timedelta(seconds=k), k % 3, 1) for k in range(60)]
    got = run_gate(spark, tmp_path, rows, EVENTS, lambda s: jobs.stream_quota(s, cfg, late))
    want = {r.event_id: r.denied_reason for r in quota.replay_admission(spark.createDataFrame(rows, EVENTS), cfg).collect()}
    assert got == want and {None, "cost_ceiling", "contribution_quota"} == set(got.values())


def test_recall_stream_equals_batch(spark, tmp_path):
    cfg = LimitConfig(recall_rate=2, recall_window=timedelta(seconds=6))
    rows = [(k, f"p{k % 2}", datetime(2024, 1, 1) + timedelta(seconds=k // 2)) for k in range(40)]
    schema = "event_id bigint, principal_id string, ts timestamp"
    got = run_gate(spark, tmp_path, rows, schema, lambda s: jobs.stream_recall_gate(s, cfg))
    assert got == {r.event_id: r.denied_reason for r in quota.recall_gate(spark.createDataFrame(rows, schema), cfg).collect()}
    assert set(got.values()) == {None, "recall_rate"}


def test_login_stream_equals_batch_and_brute_force(spark, tmp_path):
    cfg = LimitConfig(max_login_attempts=2, login_window=timedelta(seconds=9))
    rows = [(k, f"u{k % 2}", datetime(2024, 1, 1) + timedelta(seconds=k), k % 3 == 0) for k in range(50)]
    schema = "event_id bigint, email string, ts timestamp, succeeded boolean"
    failed, want = {}, {}
    for k, who, at, ok in rows:
        recent = [t for t in failed.get(who, []) if t > at - cfg.login_window]
        want[k] = "login_attempts" if len(recent) >= 2 else None
        if not ok and want[k] is None:
            failed.setdefault(who, []).append(at)
    assert {r.event_id: r.denied_reason for r in quota.login_gate(spark.createDataFrame(rows, schema), cfg).collect()} == want
    assert run_gate(spark, tmp_path, rows, schema, lambda s: jobs.stream_login_gate(s, cfg)) == want


def test_idle_state_is_cleared_by_its_timer(spark, tmp_path):
    """After an hour without events, both windows of a principal have gone; a principal that comes back starts anew."""
    cfg = LimitConfig(contribution_quota=1, contribution_window=timedelta(seconds=10), cost_window=timedelta(seconds=5))
    first = [(1, "a", datetime(2024, 1, 1), 0, 0), (2, "b", datetime(2024, 1, 1, 2), 0, 0)]
    second = [(3, "a", datetime(2024, 1, 1, 3), 0, 0), (4, "a", datetime(2024, 1, 1, 3, 0, 1), 0, 0)]
    got = run_gate(spark, tmp_path, first + second, EVENTS, lambda s: jobs.stream_quota(s, cfg, "1 second"))
    assert got == {1: None, 2: None, 3: None, 4: "contribution_quota"}


def test_a_group_holds_the_windows_of_many_principals():
    """One call of the gate judges all principals of a group, and those whose windows have passed leave its state."""
    import pandas as pd

    class State:
        exists = hasTimedOut = False
        clock = timeout = 0

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists = False

        def getCurrentWatermarkMs(self):  # noqa: N802
            return self.clock

        def setTimeoutTimestamp(self, at):  # noqa: N802
            self.timeout = at

    hour = 3_600_000_000
    cfg = LimitConfig(max_login_attempts=2, login_window=timedelta(hours=1))
    judge, state = jobs._gate(cfg, quota.Failures, True), State()

    def batch(*rows):
        frame = pd.DataFrame(rows, columns=["event_id", "principal_id", "us"]).assign(calls=1, tokens=0)
        return {r.event_id: r.denied_reason for out in judge((0,), iter([frame[:2], frame[2:]]), state) for r in out.itertuples()}

    assert batch((3, "b", 30), (1, "a", 10), (2, "a", 20), (4, "a", 40)) == {1: None, 2: None, 3: None, 4: LOGIN}
    assert batch((5, "a", 50), (6, "b", hour), (7, "c", hour)) == {5: LOGIN, 6: None, 7: None}
    state.clock = (hour + 10**6) // 1000
    assert batch((8, "c", 2 * hour - 1)) == {8: None} and sorted(set(state.get[4])) == ["b", "c"]
    assert state.timeout > (3 * hour - 1) // 1000
    state.hasTimedOut = True
    assert list(judge((0,), iter([]), state)) == [] and not state.exists
