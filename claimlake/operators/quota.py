"""Admission in event order: what is denied does not count, so the gate carries state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from datetime import timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.limits import CONTRIBUTION, COST, LOGIN, RECALL, LimitConfig


class Window:
    """What one principal was admitted to within the windows, with running sums."""

    def __init__(self, cfg: LimitConfig, spent: Iterable[tuple[int, int, int]] = (), kept: Iterable[int] | None = None):
        self.cfg = cfg
        self.long, self.short = (int(w / timedelta(microseconds=1)) for w in (cfg.contribution_window, cfg.cost_window))
        self.kept: deque[int] = deque()
        self.spent: deque[tuple[int, int, int]] = deque()
        self.calls = self.tokens = 0
        for us, calls, tokens in spent:
            self.add(us, calls, tokens)
        if kept is not None:
            self.kept = deque(kept)

    @property
    def longest(self) -> int:
        return max(self.long, self.short)

    def add(self, us: int, calls: int, tokens: int) -> None:
        self.kept.append(us)
        self.spent.append((us, calls, tokens))
        self.calls, self.tokens = self.calls + calls, self.tokens + tokens

    def admit(self, us: int, calls: int, tokens: int) -> str | None:
        """The reason of denial, or None; events come in order. The cost gate looks at what ran, then the quota at what was admitted."""
        while self.kept and self.kept[0] <= us - self.long:
            self.kept.popleft()
        while self.spent and self.spent[0][0] <= us - self.short:
            _, c, t = self.spent.popleft()
            self.calls, self.tokens = self.calls - c, self.tokens - t
        cfg = self.cfg
        if 0 < cfg.max_inference_calls <= self.calls or 0 < cfg.max_input_tokens <= self.tokens:
            return COST
        if 0 < cfg.contribution_quota <= len(self.kept):
            return CONTRIBUTION
        self.add(us, calls, tokens)
        return None


class Failures(Window):
    """Failed attempts of one address (calls: 1 if it failed); an attempt that is denied is not recorded."""

    def __init__(self, cfg: LimitConfig, spent: Iterable[tuple[int, int, int]] = (), kept: Iterable[int] | None = None):
        super().__init__(cfg, spent, kept)
        self.long = self.short = int(cfg.login_window / timedelta(microseconds=1))

    def add(self, us: int, calls: int, tokens: int) -> None:
        if calls:
            self.kept.append(us)

    def admit(self, us: int, calls: int, tokens: int) -> str | None:
        while self.kept and self.kept[0] <= us - self.long:
            self.kept.popleft()
        if 0 < self.cfg.max_login_attempts <= len(self.kept):
            return LOGIN
        self.add(us, calls, tokens)
        return None


def replay_admission(events: DataFrame, cfg: LimitConfig, admitted: DataFrame | None = None, gate_of: type[Window] = Window) -> DataFrame:
    """``events`` (event_id, principal_id, ts, calls, tokens) with ``denied_reason``; events without a principal pass.

    ``admitted`` events of before (principal_id, ts, calls, tokens) count without being
    judged. A principal's events are one sequence by nature: a task streams them in
    order, with a window as its only state; those without a principal stay where they are.
    """
    columns = [F.coalesce("principal_id", F.lit("")).alias("principal_id"), F.unix_micros("ts").alias("us"), *[F.col(c).cast("bigint").alias(c) for c in ("calls", "tokens")]]
    rows = events.select(F.col("event_id").cast("bigint").alias("event_id"), *columns)
    judged = rows.filter("principal_id != ''").withColumn("old", F.lit(False))
    if admitted is not None:
        judged = judged.unionByName(admitted.select(F.lit(None).cast("bigint").alias("event_id"), *columns, F.lit(True).alias("old")).filter("principal_id != ''"))

    def gate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, window = None, gate_of(cfg)
        for b in batches:
            reasons = []
            for who, us, calls, tokens, old in zip(*(b.column(c).to_pylist() for c in ("principal_id", "us", "calls", "tokens", "old")), strict=True):
                if who != now:
                    now, window = who, gate_of(cfg)
                one = (us, calls or 0, tokens or 0)
                reasons.append(window.add(*one) if old else window.admit(*one))
            out = pa.RecordBatch.from_arrays([b.column("event_id"), b.column("principal_id"), b.column("us"), pa.array(reasons, pa.string())], names=["event_id", "principal_id", "us", "denied_reason"])
            yield out.filter(pc.invert(b.column("old")))

    schema = "event_id bigint, principal_id string, us bigint, denied_reason string"
    order = ["principal_id", "us", F.desc("old"), "event_id"]
    done = judged.repartition("principal_id").sortWithinPartitions(*order).mapInArrow(gate, schema)
    free = rows.filter("principal_id = ''").select("event_id", "principal_id", "us", F.lit(None).cast("string").alias("denied_reason"))
    return done.unionByName(free).select("event_id", "principal_id", F.timestamp_micros("us").alias("ts"), "denied_reason")


def recall_only(cfg: LimitConfig) -> LimitConfig:
    """The recall rate in the place of the quota, and no other limit."""
    return LimitConfig(contribution_quota=cfg.recall_rate, contribution_window=cfg.recall_window, max_inference_calls=0, max_input_tokens=0)


def login_gate(attempts: DataFrame, cfg: LimitConfig) -> DataFrame:
    """``attempts`` (event_id, email, ts, succeeded) in order: an address with too many failures in the window is denied; successes never count."""
    rows = attempts.select("event_id", F.col("email").alias("principal_id"), "ts", (~F.col("succeeded")).cast("int").alias("calls"), F.lit(0).alias("tokens"))
    return replay_admission(rows, cfg, gate_of=Failures).withColumnRenamed("principal_id", "email")


def recall_gate(events: DataFrame, cfg: LimitConfig) -> DataFrame:
    """As ``replay_admission`` with the recall rate alone: completed recalls count, denials do not."""
    only = recall_only(cfg)
    rows = replay_admission(events.withColumn("calls", F.lit(0)).withColumn("tokens", F.lit(0)), only)
    return rows.withColumn("denied_reason", F.when(F.col("denied_reason").isNotNull(), F.lit(RECALL)))
