"""Limits as decisions over counters."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTRIBUTION, COST, RECALL, LOGIN = "contribution_quota", "cost_ceiling", "recall_rate", "login_attempts"


@dataclass(frozen=True)
class LimitConfig:
    """Ceilings and their windows; a ceiling of zero or less is none. Fixed values."""

    contribution_quota: int = 120
    contribution_window: timedelta = timedelta(hours=1)
    max_inference_calls: int = 500
    max_input_tokens: int = 2_000_000
    cost_window: timedelta = timedelta(hours=1)
    recall_rate: int = 120
    recall_window: timedelta = timedelta(minutes=1)
    max_package_claims: int = 50
    max_login_attempts: int = 10
    login_window: timedelta = timedelta(minutes=15)
    scope_claim_ceiling: int = 5000
    prune_aggressiveness: float = 0.5


def in_window(ts: Column, now: Column, window: timedelta) -> Column:
    """now - window < ts <= now: an event exactly one window old is out."""
    return (ts > now - F.expr(f"INTERVAL '{window.total_seconds():.6f}' SECOND")) & (ts <= now)


def at_most(used: Column, ceiling: int | Column, reason: str) -> Column:
    """struct(allowed, reason, remaining)."""
    ceiling = ceiling if isinstance(ceiling, Column) else F.lit(ceiling)
    left = (ceiling - used).cast("bigint")
    unlimited = ceiling <= 0
    allowed = unlimited | (left > 0)
    return F.struct(
        allowed.alias("allowed"),
        F.when(~allowed, F.lit(reason)).alias("reason"),
        F.when(unlimited, F.lit(-1)).otherwise(F.greatest(left, F.lit(0))).cast("bigint").alias("remaining"),
    )


def decide_contribution(used: Column, cfg: LimitConfig) -> Column:
    return at_most(used, cfg.contribution_quota, CONTRIBUTION)


def decide_recall_rate(used: Column, cfg: LimitConfig) -> Column:
    return at_most(used, cfg.recall_rate, RECALL)


def decide_login_attempts(failed: Column, cfg: LimitConfig) -> Column:
    return at_most(failed, cfg.max_login_attempts, LOGIN)


def decide_cost(calls: Column, tokens: Column, cfg: LimitConfig) -> Column:
    """Calls first, then tokens; what remains is reported in calls."""
    by_calls = at_most(calls, cfg.max_inference_calls, COST)
    over = F.lit(cfg.max_input_tokens > 0) & (tokens >= cfg.max_input_tokens)
    denied = F.struct(F.lit(False).alias("allowed"), F.lit(COST).alias("reason"), F.lit(0).cast("bigint").alias("remaining"))
    return F.when(by_calls["allowed"] & over, denied).otherwise(by_calls)


def package_cap(limit: Column, cfg: LimitConfig) -> Column:
    return F.least(limit, F.lit(cfg.max_package_claims)) if cfg.max_package_claims > 0 else limit


def prune_target(live: Column, cfg: LimitConfig) -> Column:
    """How many live claims of a scope to prune: the excess and a share of it more."""
    if cfg.scope_claim_ceiling <= 0:
        return F.lit(0).cast("bigint")
    over = live - cfg.scope_claim_ceiling
    return F.when(over <= 0, 0).otherwise(F.least(live, over + F.ceil(over * F.lit(cfg.prune_aggressiveness)))).cast("bigint")
