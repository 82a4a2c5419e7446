"""Schemas of the logical tables. Hashes are hexadecimal, open ends of intervals are null."""

from __future__ import annotations

_INTERVALS = "valid_from timestamp, valid_until timestamp, recorded_at timestamp, superseded_at timestamp"

SCHEMAS: dict[str, str] = {
    "principals": "id string, kind string, display_name string, recorded_at timestamp, superseded_at timestamp",
    "evidence": (
        "id string, source_kind string, source_repo string, source_path string, chunk_ordinal int, line_start int, line_end int, "
        f"extracted_text string, content_sha256 string, attested_by string, attested_at timestamp, {_INTERVALS}, "
        "anchor_symbol_path string, anchor_node_hash string, anchor_window_hash string"
    ),
    "claims": (
        f"id string, kind string, statement string, scope_kind string, scope_value string, {_INTERVALS}, superseded_by string, "
        "confidence double, source_repo string, source_commit string, extracted_by_model string, prompt_version string, "
        "statement_sha256 string, supersede_reason string, contributed_by string"
    ),
    "claim_evidence": "claim_id string, evidence_id string",
    "claim_acl": "claim_id string, principal_id string, expires_at timestamp",
    "evidence_acl": "evidence_id string, principal_id string, expires_at timestamp",
    "embedding_models": "id int, name string, dimensions int, status string",
    "claim_embeddings": "embedding_model_id int, claim_id string, embedding array<float>",
    "usage_events": (
        "id bigint, principal_id string, scope_kind string, scope_value string, kind string, inference_calls int, input_tokens int, "
        "output_tokens int, wall_ms bigint, package_claims int, denied_reason string, recorded_at timestamp"
    ),
    "login_attempts": "id bigint, email string, succeeded boolean, recorded_at timestamp",
    "tokens": "id string, subject string, role string, created_at timestamp, expires_at timestamp, used_at timestamp, revoked_at timestamp",
    "files": "repo string, path string, text string",
    "captures": (
        "job_id string, source string, source_kind string, repo string, path string, base_line int, scope_kind string, scope_value string, "
        "principals array<string>, trigger string, ts timestamp"
    ),
    "candidates": "job_id string, kind string, statement string, quote string, confidence double",
    "model_responses": (
        "job_id string, attempt int, raw string, stop_reason string, input_tokens int, output_tokens int, wall_ms bigint, error string"
    ),
}

#: Closed sets of values. Fixed values.
ENUMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("principals", "kind"): ("user", "team", "org", "agent"),
    ("evidence", "source_kind"): ("document", "code", "attestation"),
    ("claims", "kind"): ("Convention", "Decision", "Constraint", "RejectedApproach", "Failure", "Reference"),
    ("claims", "scope_kind"): ("organization", "repository", "path", "service"),
    ("claims", "supersede_reason"): ("duplicate", "contradiction", "forgotten", "stale_anchor", "pruned"),
    ("embedding_models", "status"): ("PRESENT", "FUTURE", "RETIRED"),
    ("usage_events", "kind"): ("inference", "recall", "denied"),
    ("tokens", "role"): ("admin", "member"),
}
CLAIM_KINDS = ENUMS["claims", "kind"]


def empty(spark, table: str):
    """An empty DataFrame of a logical table."""
    return spark.createDataFrame([], SCHEMAS[table])
