"""Exact de-duplication of live statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import ranges, scan
from .scd import apply_supersession

#: Groups whose survivors are sent to every task at most, and probes.
SMALL, PROBES = 100_000, 4096
#: Both dimensions of time, against the instants of a probe.
AXES = [ranges.Axis("valid_from", "valid_until", "valid_at"), ranges.Axis("recorded_at", "superseded_at", "known_at")]


def canonical(claims: DataFrame) -> DataFrame:
    """(statement_sha256, survivor) of live statements that stand twice: the earliest recorded, then the least id.

    Seeded claims, whose hash is null, never do.
    """
    live = claims.filter("superseded_at is null and statement_sha256 is not null")
    least = F.min_by("id", F.struct("recorded_at", "id")).alias("survivor")
    return live.groupBy("statement_sha256").agg(least, F.count("*").alias("n")).filter("n > 1").select("statement_sha256", "survivor")


def duplicate_groups(claims: DataFrame) -> DataFrame:
    """Live claims whose statement hash another live claim has, with the ``survivor`` of the group.

    Survivors of a checked number go to every task, so a statement that many claims
    repeat is no single task's.
    """
    live = claims.filter("superseded_at is null and statement_sha256 is not null")
    twice = written(canonical(claims))
    return live.join(F.broadcast(twice) if twice.limit(SMALL + 1).count() <= SMALL else twice, "statement_sha256")


def duplicate_closures(claims: DataFrame, now: Column) -> DataFrame:
    """What a pass at ``now`` closes: id, successor, at, reason of all but the survivor of each group, whatever their scope or access."""
    pairs = duplicate_groups(claims).filter("id != survivor")
    return pairs.select("id", F.col("survivor").alias("successor"), now.alias("at"), F.lit("duplicate").alias("reason"))


def dedup_claims(claims: DataFrame, now: Column) -> DataFrame:
    """``claims`` with their ``duplicate_closures``; a second run changes nothing, and a claim recorded at ``now`` or later stays open until a later pass."""
    return apply_supersession(claims, duplicate_closures(claims, now))


def current_at(rows: DataFrame, valid_at: Column, recorded_at: Column) -> DataFrame:
    """Rows that held at ``valid_at`` as known at ``recorded_at``."""
    from ..functions.intervals import iv_contains

    valid = iv_contains(F.col("valid_from"), F.col("valid_until"), valid_at)
    return rows.filter(valid & iv_contains(F.col("recorded_at"), F.col("superseded_at"), recorded_at))


def known_at(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (probe_id, valid_at, known_at): the rows that ``current_at`` gives.

    Probes of a checked number are sent to every task; more meet the rows in bins of time.
    """
    on = (
        (F.col("valid_from") <= F.col("valid_at")) & (F.col("valid_until").isNull() | (F.col("valid_at") < F.col("valid_until")))
        & (F.col("recorded_at") <= F.col("known_at")) & (F.col("superseded_at").isNull() | (F.col("known_at") < F.col("superseded_at")))
    )
    if probes.limit(PROBES + 1).count() <= PROBES:
        return rows.join(F.broadcast(probes), on)
    return ranges.stab(written(rows), written(probes), AXES)


def known_tally(rows: DataFrame, probes: DataFrame, least: str, key: str) -> DataFrame:
    """For each probe ``key`` to which ``known_at`` gives rows: how many (``n``), and the least ``least`` of them (``first``). No pair is made."""
    return ranges.tally(rows, probes, AXES, least, key)


def valid_time_overlaps(rows: DataFrame, key: str) -> DataFrame:
    """Rows that begin before an earlier row of their key has ended; empty when none overlap.

    A running maximum, not a join of pairs, and a scan where a key holds very many rows.
    """
    forever = F.lit("9999-12-31 00:00:00").cast("timestamp")
    ends = rows.withColumn("_ends", F.coalesce("valid_until", forever))
    before = scan.running(ends, [key], ["valid_from", "id"], "_ends", "max", "_before", own=False)
    return before.filter(F.col("_before") > F.col("valid_from")).drop("_before", "_ends")
