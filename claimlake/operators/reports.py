"""Listings, counts and usage over claims and ledgers."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import limits

PAGE, PAGE_MAX = 50, 200


def claim_status(now: Column) -> Column:
    gone = F.col("superseded_at").isNotNull() | (F.col("valid_until").isNotNull() & (F.col("valid_until") <= now))
    return F.when(gone, "expired").otherwise("live")


def list_claims(claims: DataFrame, now: Column, status: str = "all", scope_kind: str = "", scope_value: str = "", claim_id: str = "") -> DataFrame:
    """Filtered claims with ``status``; an id overrides every other filter. Order with ``listing_order``."""
    out = claims.withColumn("status", claim_status(now))
    if claim_id:
        return out.filter(F.col("id") == claim_id)
    if status != "all":
        out = out.filter(F.col("status") == status)
    if scope_kind:
        out = out.filter(F.col("scope_kind") == scope_kind)
    if scope_value:
        out = out.filter(F.col("scope_value") == scope_value)
    return out


def listing_order() -> list[Column]:
    return [F.desc("recorded_at"), F.asc("id")]


def page_claims(readable: DataFrame, key: str, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page for each ``key`` of rows that it may read: ``position`` offset + 1 to offset + limit."""
    limit = PAGE if limit <= 0 else min(limit, PAGE_MAX)
    offset = max(0, offset)
    ranked = readable.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*listing_order())))
    return ranked.filter((F.col("position") <= offset + limit) & (F.col("position") > offset))


def recent_writes(claims: DataFrame, limit: int = 20) -> DataFrame:
    """Newest claims that a model extracted, with a label: live, the reason, or superseded."""
    label = F.when(F.col("superseded_at").isNull(), "live").otherwise(F.coalesce("supersede_reason", F.lit("superseded")))
    return claims.filter("extracted_by_model != ''").withColumn("label", label).orderBy(*listing_order()).limit(limit)


def claim_rows(claims: DataFrame, links: DataFrame, evidence: DataFrame, now: Column) -> DataFrame:
    """One row a claim with the place of its first evidence and times as text."""
    at = F.struct("source_path", "line_start", evidence["id"])
    first = links.join(evidence, links["evidence_id"] == evidence["id"]).groupBy("claim_id").agg(F.min_by(F.concat_ws(":", "source_path", "line_start"), at).alias("source"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    out = claims.join(first, claims["id"] == first["claim_id"], "left")
    return out.select("id", "kind", "statement", claim_status(now).alias("status"), F.coalesce("source", F.lit("")).alias("source"), stamp("recorded_at"), stamp("valid_from"))


def evidence_anchor_state(evidence: DataFrame) -> DataFrame:
    state = F.when(F.coalesce("anchor_symbol_path", F.lit("")) != "", "anchored").otherwise("unanchored")
    return evidence.withColumn("anchor_state", state)


def pending_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """Unused, unrevoked, unexpired; oldest first by ``created_at``, id."""
    return tokens.filter(F.col("used_at").isNull() & F.col("revoked_at").isNull() & (F.col("expires_at") > now))


def session_principals(sessions: DataFrame, credentials: DataFrame, now: Column) -> DataFrame:
    """(token, principal_id, role) of sessions that have not expired; a role of '' without credentials."""
    roles = credentials.select("principal_id", "role")
    return sessions.filter(F.col("expires_at") > now).join(roles, "principal_id", "left").select("token", "principal_id", F.coalesce("role", F.lit("")).alias("role"))


def role_of(principals: DataFrame, credentials: DataFrame) -> DataFrame:
    return principals.join(credentials.select("principal_id", "role"), "principal_id", "left").withColumn("role", F.coalesce("role", F.lit("")))


def claims_of_repo(claims: DataFrame, links: DataFrame, evidence: DataFrame, repo: str) -> DataFrame:
    """Live claims with evidence in a repository."""
    own = links.join(evidence.filter(F.col("source_repo") == repo), links["evidence_id"] == evidence["id"]).select("claim_id")
    return claims.filter("superseded_at is null").join(own, claims["id"] == own["claim_id"], "left_semi")


def usage_by_scope(ledger: DataFrame, since: Column) -> DataFrame:
    used = ledger.filter((F.col("kind") == "inference") & (F.col("recorded_at") > since))
    return used.groupBy("scope_kind", "scope_value").agg(
        F.sum("inference_calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )


def scope_sizes(claims: DataFrame) -> DataFrame:
    return claims.filter("superseded_at is null").groupBy("scope_kind", "scope_value").agg(F.count("*").alias("live"))


def live_counts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: live claims and live evidence."""
    each = [t.filter("superseded_at is null").select(F.lit(n).alias("t")) for n, t in (("claims", claims), ("evidence", evidence))]
    return each[0].union(each[1]).agg(F.count_if(F.col("t") == "claims").alias("claims"), F.count_if(F.col("t") == "evidence").alias("evidence"))


def org_usage_report(ledger: DataFrame, claims: DataFrame, since: Column, cfg: limits.LimitConfig) -> DataFrame:
    """Usage and size of each scope, and how many claims its next pruning takes."""
    both = usage_by_scope(ledger, since).join(scope_sizes(claims), ["scope_kind", "scope_value"], "full")
    live = F.coalesce("live", F.lit(0))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "input_tokens", "output_tokens")]
    return both.select("scope_kind", "scope_value", *zero, live.alias("live"), limits.prune_target(live, cfg).alias("next_prune"), F.lit(cfg.scope_claim_ceiling).alias("ceiling"))


def window_state(claims: DataFrame, ledger: DataFrame, now: Column, cfg: limits.LimitConfig) -> DataFrame:
    """Counters of each principal, each over its own window. Superseded contributions count."""
    own = claims.filter("contributed_by != ''").groupBy(F.col("contributed_by").alias("principal_id"))
    own = own.agg(F.count_if(limits.in_window(F.col("recorded_at"), now, cfg.contribution_window)).alias("contributions"))

    def counted(kind: str, window: timedelta) -> Column:
        return (F.col("kind") == kind) & limits.in_window(F.col("recorded_at"), now, window)

    cost = counted("inference", cfg.cost_window)
    used = ledger.groupBy("principal_id").agg(
        F.coalesce(F.sum(F.when(cost, F.col("inference_calls"))), F.lit(0)).alias("calls"),
        F.coalesce(F.sum(F.when(cost, F.col("input_tokens"))), F.lit(0)).alias("tokens"),
        F.count_if(counted("recall", cfg.recall_window)).alias("recalls"),
        F.count_if(counted("denied", cfg.contribution_window)).alias("denied"),
    )
    names = ("contributions", "calls", "tokens", "recalls", "denied")
    return own.join(used, "principal_id", "full").select("principal_id", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def usage_report(state: DataFrame, cfg: limits.LimitConfig) -> DataFrame:
    """What each principal has left, and why not."""
    each = {
        "contribution": (limits.decide_contribution(F.col("contributions"), cfg), "contributions", cfg.contribution_quota),
        "cost": (limits.decide_cost(F.col("calls"), F.col("tokens"), cfg), "calls", cfg.max_inference_calls),
        "recall": (limits.decide_recall_rate(F.col("recalls"), cfg), "recalls", cfg.recall_rate),
    }
    rows = [
        F.struct(F.lit(n).alias("gate"), F.col(used).alias("used"), F.lit(top).alias("ceiling"), d["allowed"].alias("allowed"), d["reason"].alias("reason"), d["remaining"].alias("remaining"))
        for n, (d, used, top) in each.items()
    ]
    return state.select("principal_id", "denied", F.explode(F.array(*rows)).alias("r")).select("principal_id", "r.*", "denied")


def failed_logins(attempts: DataFrame, now: Column, cfg: limits.LimitConfig) -> DataFrame:
    """Failures of each address in the window and the decision; successes never count."""
    failed = F.count_if(~F.col("succeeded") & limits.in_window(F.col("recorded_at"), now, cfg.login_window))
    out = attempts.groupBy("email").agg(failed.alias("failed"))
    return out.withColumn("d", limits.decide_login_attempts(F.col("failed"), cfg)).select("email", "failed", "d.allowed", "d.remaining")
