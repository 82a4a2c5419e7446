"""Transitions of bi-temporal tables: each takes snapshots and returns new ones.

Nothing is deleted. All are guarded on ``superseded_at is null``, so a second run
changes nothing; a writer puts the new snapshot beside the old and then switches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import limits
from ..functions.intervals import supersede
from ..schemas import CLAIM_KINDS
from ..sources.scratch import written


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def seed_merge(live: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """``live`` and ``chunks`` keyed (repo, path, ordinal) with content_sha256, statement; live also with id.

    Returns every row with ``action``: unchanged, superseded (closed now, ``superseded_by``
    set), inserted. Chunks that vanish stay live, as ``vanished``.
    """
    key = ["repo", "path", "ordinal"]
    new = chunks.select(*key, F.col("content_sha256").alias("new_sha"), F.col("statement").alias("new_statement"))
    both = live.withColumn("_old", F.lit(True)).join(new, key, "full")
    new_id = stable_id(*[F.col(k) for k in key], F.col("new_sha"))
    changed = F.col("_old") & F.col("new_sha").isNotNull() & ~F.col("content_sha256").eqNullSafe(F.col("new_sha"))
    action = (
        F.when(F.col("_old").isNull(), "inserted").when(F.col("new_sha").isNull(), "vanished").when(changed, "superseded").otherwise("unchanged")
    )
    marked = both.withColumn("action", action).withColumn("new_id", new_id)
    closed = F.when(F.col("action") == "superseded", now)
    kept = marked.filter("action != 'inserted'").select(
        *key, "id", "content_sha256", "statement", closed.alias("superseded_at"), closed.alias("valid_until"),
        F.when(F.col("action") == "superseded", F.col("new_id")).alias("superseded_by"), "action",
    )
    none = F.lit(None)
    fresh = marked.filter("action in ('inserted', 'superseded')").select(
        *key, F.col("new_id").alias("id"), F.col("new_sha").alias("content_sha256"), F.col("new_statement").alias("statement"),
        none.cast("timestamp").alias("superseded_at"), none.cast("timestamp").alias("valid_until"), none.cast("string").alias("superseded_by"),
        F.lit("inserted").alias("action"),
    )
    return kept.unionByName(fresh)


def seed_report(merged: DataFrame) -> DataFrame:
    """files, chunks, inserted (what supersedes included), superseded, unchanged."""
    return merged.agg(
        F.countDistinct(F.when(F.col("action").isin("inserted", "unchanged"), F.struct("repo", "path"))).alias("files"),
        F.count_if(F.col("action").isin("inserted", "unchanged")).alias("chunks"),
        F.count_if(F.col("action") == "inserted").alias("inserted"),
        F.count_if(F.col("action") == "superseded").alias("superseded"),
        F.count_if(F.col("action") == "unchanged").alias("unchanged"),
    )


def seed_claim_defaults(chunks: DataFrame, now: Column) -> DataFrame:
    """Claims of seeded chunks (repo, path, ordinal, statement, content_sha256): references of middling confidence."""
    return chunks.select(
        stable_id(F.col("repo"), F.col("path"), F.col("ordinal"), F.col("content_sha256")).alias("id"),
        F.lit("Reference").alias("kind"), "statement", F.lit("path").alias("scope_kind"), F.col("path").alias("scope_value"),
        now.alias("valid_from"), now.alias("recorded_at"), F.lit(0.5).alias("confidence"), F.col("repo").alias("source_repo"),
        F.lit("").alias("extracted_by_model"), F.lit("").alias("contributed_by"),
    )


def apply_supersession(claims: DataFrame, closures: DataFrame) -> DataFrame:
    """``closures`` (id, successor, at, reason) on ``claims``; claims already closed, or bad closures, change nothing."""
    c = closures.select(F.col("id").alias("_id"), "successor", "at", F.col("reason").alias("_reason"))
    joined = claims.join(c, claims["id"] == c["_id"], "left")
    cols = {k: F.col(k) for k in ("id", "valid_from", "valid_until", "recorded_at", "superseded_at")}
    joined = joined.withColumn("_s", F.when(F.col("_id").isNotNull(), supersede(cols, F.col("successor"), F.col("at"))))
    ok = F.col("_s").isNotNull() & F.col("_s.error").isNull()
    changed = {
        "superseded_at": F.when(ok, F.col("_s.superseded_at")).otherwise(F.col("superseded_at")),
        "valid_until": F.when(ok, F.col("_s.valid_until")).otherwise(F.col("valid_until")),
        "superseded_by": F.when(ok, F.col("_s.superseded_by")).otherwise(F.col("superseded_by")),
        "supersede_reason": F.when(ok, F.col("_reason")).otherwise(F.col("supersede_reason")),
    }
    return joined.select(*[changed[x].alias(x) if x in changed else F.col(x) for x in claims.columns])


def expire_claims(claims: DataFrame, ids: DataFrame, reason: str, now: Column) -> DataFrame:
    """Close live claims without a successor; an earlier ``valid_until`` is overwritten."""
    hit = ids.select(F.col("id").alias("_id")).distinct()
    joined = claims.join(hit, claims["id"] == hit["_id"], "left")
    live = F.col("_id").isNotNull() & F.col("superseded_at").isNull()
    changed = {"superseded_at": now, "valid_until": now, "supersede_reason": F.lit(reason)}
    return joined.select(*[F.when(live, changed[x]).otherwise(F.col(x)).alias(x) if x in changed else F.col(x) for x in claims.columns])


#: Bins that narrow the claims of least value down before any is ranked: confidence, roughly and then exactly, and the hour.
PRUNE_BINS = ("floor(coalesce(confidence, -1.0) * 1024)", "coalesce(confidence, -1.0)", "floor(coalesce(unix_seconds(recorded_at), -1e12) / 3600)")


def prune_scopes(claims: DataFrame, cfg: limits.LimitConfig, now: Column) -> DataFrame:
    """Expire the claims of least value in every scope that is over its ceiling: confidence, then age, then id.

    Scopes within their ceiling are only counted. In the others, counts by bin tell
    which bins go whole and which one holds the last claims to go; only that one is
    ranked, so a scope that holds most claims is no single task's.
    """
    scope = ["scope_kind", "scope_value"]
    live = claims.filter("superseded_at is null").select("id", *scope, "confidence", "recorded_at")
    target = live.groupBy(*scope).agg(limits.prune_target(F.count("*"), cfg).cast("bigint").alias("target")).filter("target > 0")
    # written at each step, as each is read three times and smaller than the one before
    left, gone = written(live.join(target, scope)), []
    for key in PRUNE_BINS:
        left = left.withColumn("bin", F.expr(key))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*scope).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes = left.groupBy(*scope, "bin").agg(F.count("*").alias("n"), F.first("target").alias("target")).withColumn("before", before)
        edge = sizes.filter("before < target and before + n >= target").select(*scope, F.col("bin").alias("edge"), (F.col("target") - F.col("before")).alias("rest"))
        placed = left.join(edge, scope)
        gone.append(placed.filter("bin < edge").select("id"))
        left = written(placed.filter("bin = edge").select("id", *scope, "confidence", "recorded_at", F.col("rest").alias("target")))
    order = Window.partitionBy(*scope).orderBy("confidence", "recorded_at", "id")
    gone.append(left.withColumn("n", F.row_number().over(order)).filter("n <= target").select("id"))
    return expire_claims(claims, reduce(DataFrame.unionByName, gone), "pruned", now)


def record_usage(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Append to the ledger; an inference counts one call, everything else none."""
    calls = F.when(F.col("kind") == "inference", 1).otherwise(0).cast("int")
    return ledger.unionByName(events.withColumn("inference_calls", calls), allowMissingColumns=True)


def attest_claims(attestations: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """``attestations`` (principal_id, statement, kind) to (claims with their own evidence, rejected with a reason)."""
    kind = F.when(F.trim(F.coalesce("kind", F.lit(""))) == "", "Reference").otherwise(F.col("kind"))
    reason = (
        F.when(F.trim(F.coalesce("statement", F.lit(""))) == "", "blank statement")
        .when(F.trim(F.coalesce("principal_id", F.lit(""))) == "", "no principal")
        .when(~kind.isin(*CLAIM_KINDS), "unknown kind")
    )
    marked = attestations.withColumn("reason", reason)
    accepted = marked.filter("reason is null").select(
        stable_id(F.col("principal_id"), F.col("statement"), now).alias("id"), kind.alias("kind"), "statement",
        F.lit("organization").alias("scope_kind"), F.lit("attested").alias("scope_value"), now.alias("valid_from"), now.alias("recorded_at"),
        F.lit(0.7).alias("confidence"), F.col("principal_id").alias("contributed_by"), F.lit("attestation").alias("source_kind"),
        F.lit("attestation").alias("source_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.col("statement").alias("extracted_text"),
    )
    return accepted, marked.filter("reason is not null")


def write_claims(candidates: DataFrame, model_id: int, now: Column) -> dict[str, DataFrame]:
    """One batch of located candidates as the rows of six tables.

    ``candidates``: job_id, kind, statement, confidence, scope_kind, scope_value, repo, path, line_start, line_end,
    text, source_kind, symbol_path, node_hash, window_hash, principals, prompt_version, embedding.
    """
    claim = stable_id(F.col("job_id"), F.col("statement"), F.col("path"), F.col("line_start"))
    rows = candidates.withColumn("claim_id", claim).withColumn("evidence_id", stable_id(claim, F.lit("evidence")))
    interval = [now.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"), now.alias("recorded_at"), F.lit(None).cast("timestamp").alias("superseded_at")]
    grant = [F.explode("principals").alias("principal_id"), F.lit(None).cast("timestamp").alias("expires_at")]
    return {
        "evidence": rows.select(
            F.col("evidence_id").alias("id"), "source_kind", F.col("repo").alias("source_repo"), F.col("path").alias("source_path"),
            F.lit(None).cast("int").alias("chunk_ordinal"), "line_start", "line_end", F.col("text").alias("extracted_text"),
            F.sha2("text", 256).alias("content_sha256"), *interval, F.col("symbol_path").alias("anchor_symbol_path"),
            F.col("node_hash").alias("anchor_node_hash"), F.col("window_hash").alias("anchor_window_hash"),
        ),
        "claims": rows.select(
            F.col("claim_id").alias("id"), "kind", "statement", "scope_kind", "scope_value", *interval, F.lit(None).cast("string").alias("superseded_by"),
            "confidence", F.col("repo").alias("source_repo"), F.col("prompt_version").alias("extracted_by_model"), "prompt_version",
            F.sha2(F.trim(F.regexp_replace(F.lower("statement"), r"[\s\u0085\p{Z}]+", " ")), 256).alias("statement_sha256"),
            F.lit(None).cast("string").alias("supersede_reason"), F.coalesce(F.try_element_at("principals", F.lit(1)), F.lit("")).alias("contributed_by"),
        ),
        "claim_evidence": rows.select("claim_id", "evidence_id"),
        "claim_acl": rows.select("claim_id", *grant),
        "evidence_acl": rows.select("evidence_id", *grant),
        "claim_embeddings": rows.select(F.lit(model_id).alias("embedding_model_id"), "claim_id", "embedding"),
    }
