"""Half-open intervals [from, until); a null until is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Why an interval can't be closed at an instant before it began.
TOO_EARLY = "not after its start"


def is_open(until: Column) -> Column:
    return until.isNull()


def iv_well_formed(start: Column, until: Column) -> Column:
    return until.isNull() | (start < until)


def iv_contains(start: Column, until: Column, at: Column) -> Column:
    return (start <= at) & (until.isNull() | (at < until))


def iv_overlaps(a_start: Column, a_until: Column, b_start: Column, b_until: Column) -> Column:
    """Sharing an instant; intervals that only meet share none."""
    return (b_until.isNull() | (a_start < b_until)) & (a_until.isNull() | (b_start < a_until))


def iv_meets(a_until: Column, b_start: Column) -> Column:
    return F.coalesce(a_until == b_start, F.lit(False))


def iv_close(start: Column, until: Column, at: Column) -> Column:
    """struct(until, error): an open interval closed at ``at``; never clamped, an error says why not."""
    error = F.when(until.isNotNull(), "already closed").when(at <= start, TOO_EARLY)
    return F.struct(F.when(error.isNull(), at).alias("until"), error.alias("error"))


def supersede(claim: dict[str, Column], successor: Column, at: Column) -> Column:
    """struct(superseded_at, valid_until, superseded_by, error) of a claim that a successor replaces.

    The recorded interval must be open; the valid one is closed only if it is.
    """
    recorded = iv_close(claim["recorded_at"], claim["superseded_at"], at)
    valid = iv_close(claim["valid_from"], claim["valid_until"], at)
    error = (
        F.when(F.coalesce(successor, F.lit("")) == "", "no successor")
        .when(successor == claim["id"], "its own successor")
        .otherwise(F.coalesce(recorded["error"], F.when(claim["valid_until"].isNull(), valid["error"])))
    )
    fine = error.isNull()
    return F.struct(
        F.when(fine, at).otherwise(claim["superseded_at"]).alias("superseded_at"),
        F.when(fine, F.coalesce(claim["valid_until"], at)).otherwise(claim["valid_until"]).alias("valid_until"),
        F.when(fine, successor).alias("superseded_by"),
        error.alias("error"),
    )
