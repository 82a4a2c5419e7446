"""Streaming jobs. Every step of a batch is idempotent, since a batch may run again."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.limits import RECALL, LimitConfig
from ..operators import dedup, nominate, quota, scd
from ..sources.scratch import written

TICK = "interval 1 microsecond"


#: Groups of principals whose windows are one row of state: a group costs some milliseconds a batch, a principal next to nothing.
GROUPS = 1024
_SPENT = "spender array<string>, us array<bigint>, calls array<bigint>, tokens array<bigint>, keeper array<string>, kept array<bigint>"


def _gate(cfg: LimitConfig, gate_of: type[quota.Window], timed: bool) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Admission of a group of principals: what each was admitted to within the two windows is the state, which comes and goes with the group's rows."""

    def judge(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the windows of all have passed
            state.remove()
            return
        old: dict[str, tuple[list, list]] = {}
        if state.exists:
            spender, us, calls, tokens, keeper, kept = state.get
            for who, *one in zip(spender, us, calls, tokens, strict=True):
                old.setdefault(who, ([], []))[0].append(tuple(one))
            for who, at in zip(keeper, kept, strict=True):
                old.setdefault(who, ([], []))[1].append(at)
        frame = pd.concat(list(rows)).sort_values(["principal_id", "us", "event_id"])  # of one batch
        windows: dict[str, quota.Window] = {}
        denied = []
        for who, *event in zip(*(frame[c].tolist() for c in ("principal_id", "us", "calls", "tokens")), strict=True):
            if who not in windows:
                windows[who] = gate_of(cfg, *old.get(who, ((), ())))
            denied.append(windows[who].admit(*event))
        left = old | {who: (w.spent, w.kept) for who, w in windows.items()}
        longest, clock = gate_of(cfg).longest, state.getCurrentWatermarkMs() if timed else 0
        last = {who: max([s[0] for s in spent] + list(kept), default=None) for who, (spent, kept) in left.items()}
        left = {who: x for who, x in left.items() if last[who] is not None and (not timed or last[who] + longest > clock * 1000)}
        if left:
            spent = [(who, *s) for who, x in left.items() for s in x[0]]
            kept = [(who, at) for who, x in left.items() for at in x[1]]
            state.update((*([s[k] for s in spent] for k in range(4)), *([s[k] for s in kept] for k in range(2))))
            if timed:
                state.setTimeoutTimestamp(max(max(last[who] for who in left) + longest, clock * 1000) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield frame[["event_id", "principal_id", "us"]].assign(denied_reason=denied)

    return judge


def stream_quota(events: DataFrame, cfg: LimitConfig, late: str | None = None, gate_of: type[quota.Window] = quota.Window) -> DataFrame:
    """Continuous ``replay_admission``: event_id, principal_id, us, denied_reason.

    Each principal's windows are in state, the quota's and the cost's apart; events
    without a principal pass beside it. Events of a principal must not come a batch
    late. With ``late``, a watermark drops what comes later than that, and the state of
    a principal goes with the next batch of its group, or by a timer, once both windows have passed.
    """
    rows = events.withWatermark("ts", late) if late else events
    rows = rows.select(
        F.col("event_id").cast("bigint").alias("event_id"), F.coalesce("principal_id", F.lit("")).alias("principal_id"), F.unix_micros("ts").alias("us"),
        *[F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in ("calls", "tokens")], *(["ts"] if late else []),
    )
    schema = "event_id bigint, principal_id string, us bigint, denied_reason string"
    grouped = rows.filter("principal_id != ''").withColumn("some", F.pmod(F.xxhash64("principal_id"), F.lit(GROUPS)))
    gated = grouped.groupBy("some").applyInPandasWithState(
        _gate(cfg, gate_of, late is not None), schema, _SPENT, "append", GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    )
    return gated.unionByName(rows.filter("principal_id = ''").select("event_id", "principal_id", "us", F.lit(None).cast("string").alias("denied_reason")))


def stream_recall_gate(events: DataFrame, cfg: LimitConfig, late: str | None = None) -> DataFrame:
    """Continuous ``recall_gate`` of events (event_id, principal_id, ts)."""
    rows = events.withColumn("calls", F.lit(0)).withColumn("tokens", F.lit(0))
    out = stream_quota(rows, quota.recall_only(cfg), late)
    return out.withColumn("denied_reason", F.when(F.col("denied_reason").isNotNull(), F.lit(RECALL)))


def stream_login_gate(attempts: DataFrame, cfg: LimitConfig, late: str | None = None) -> DataFrame:
    """Continuous ``login_gate`` of attempts (event_id, email, ts, succeeded)."""
    rows = attempts.select("event_id", F.col("email").alias("principal_id"), "ts", (~F.col("succeeded")).cast("int").alias("calls"), F.lit(0).alias("tokens"))
    return stream_quota(rows, cfg, late, quota.Failures).withColumnRenamed("principal_id", "email")


def stream_usage(ledger: DataFrame, window: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Rolling usage of each scope; rows later than the watermark are dropped."""
    rows = ledger.filter("kind = 'inference'").withWatermark("recorded_at", late)
    grouped = rows.groupBy(F.window("recorded_at", window, slide).alias("w"), "scope_kind", "scope_value")
    sums = grouped.agg(F.sum("inference_calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return sums.select("w.start", "w.end", "scope_kind", "scope_value", "calls", "input_tokens", "output_tokens")


def _run(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_retries(start: Callable[[], StreamingQuery], attempts: int = 5, wait: float = 1.0) -> StreamingQuery:
    """Run a job to its end; after an error it starts again from its checkpoint, ``attempts`` times in all, waiting twice as long each time.

    A denial is data and raises nothing, so it is never tried again.
    """
    for attempt in range(1, attempts + 1):
        query = start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            if attempt == attempts:
                raise
            time.sleep(wait * 2 ** (attempt - 1))
    raise ValueError("attempts must be one at least")


def batch_clock(batch: DataFrame, live: DataFrame, ts: str = "ts") -> Column | None:
    """The time of a batch: its latest event, or just after whatever was recorded before it; null for a batch without events.

    It comes from the data, so a batch that runs again has the same clock.
    """
    last = batch.agg(F.max(ts).alias("t")).first().t
    if last is None:
        return None
    known = live.agg(F.max("recorded_at").alias("t")).first().t if "recorded_at" in live.columns else None
    return F.lit(max(last, known + timedelta(microseconds=1)) if known else last).cast("timestamp")


def stream_seed(chunks: DataFrame, read_live: Callable[[int], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, ts: str = "ts") -> StreamingQuery:
    """Re-seed as chunks of changed files arrive: ``seed_merge`` of each batch, written as a new snapshot by batch number.

    ``read_live`` gets the batch's number and gives the snapshot of the batches before it.
    Of a place that comes twice in a batch, the latest chunk counts.
    """

    def step(batch: DataFrame, n: int) -> None:
        live = read_live(n)
        now = batch_clock(batch, live, ts)
        if now is None:
            return
        place = Window.partitionBy("repo", "path", "ordinal").orderBy(F.desc(ts), "content_sha256")
        latest = batch.withColumn("_n", F.row_number().over(place)).filter("_n = 1").drop("_n")
        write(scd.seed_merge(live, latest, now), n)

    return _run(chunks, checkpoint, step)


def stream_dedup(claims: DataFrame, read_claims: Callable[[int], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """New claims as they are recorded: a de-duplication pass over all claims after each batch, written as a snapshot."""

    def step(batch: DataFrame, n: int) -> None:
        before = read_claims(n)
        now = batch_clock(batch, before, "recorded_at")
        if now is None:
            return
        both = before.unionByName(batch, allowMissingColumns=True).dropDuplicates(["id"])
        write(dedup.dedup_claims(both, now + F.expr(TICK)), n)

    return _run(claims, checkpoint, step)


def stream_capture(
    captures: DataFrame, cfg: LimitConfig, read_claims: Callable[[int], DataFrame], read_admitted: Callable[[int], DataFrame],
    write: Callable[[dict[str, DataFrame], int], None], checkpoint: str,
) -> StreamingQuery:
    """Captures through the gate, candidates, quotes and anchors, then de-duplication and pruning, batch by batch.

    Both readers get the batch's number and give what the batches before it left: the
    claims, and the admitted events (principal_id, ts, calls, tokens), so that one
    quota serves all batches. ``write`` gets the new rows of each table, ``admitted``
    and ``denied`` events, and the whole ``claims`` snapshot as ``snapshot``.
    """

    def step(batch: DataFrame, n: int) -> None:
        before = read_claims(n)
        now = batch_clock(batch, before)
        if now is None:
            return
        jobs = batch.withColumn("event_id", F.xxhash64("job_id")).withColumn("principal_id", F.coalesce(F.try_element_at("principals", F.lit(1)), F.lit("")))
        events = jobs.select("event_id", "principal_id", "ts", F.lit(1).alias("calls"), F.length("source").alias("tokens"))
        judged = written(quota.replay_admission(events, cfg, read_admitted(n)))
        passed = judged.filter("denied_reason is null").select("event_id")
        allowed = jobs.join(passed, "event_id", "left_semi").drop("event_id", "principal_id")
        found, _ = nominate.write_candidates(nominate.line_candidates(allowed), allowed)
        rows = found.withColumn("prompt_version", F.lit("lines")).withColumn("embedding", F.array().cast("array<float>"))
        tables = scd.write_claims(rows, 1, now)
        claims = written(before.unionByName(tables["claims"], allowMissingColumns=True).dropDuplicates(["id"]))
        after = now + F.expr(TICK)  # nothing closes at the instant at which it was recorded
        tables["snapshot"] = scd.prune_scopes(dedup.dedup_claims(claims, after), cfg, after)
        tables["admitted"] = events.join(passed, "event_id", "left_semi").drop("event_id")
        tables["denied"] = judged.filter("denied_reason is not null")
        write(tables, n)

    return _run(captures, checkpoint, step)
