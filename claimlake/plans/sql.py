"""The fixtures of ``plans.fixtures`` as DuckDB SQL, for the oracle queries."""

NOW = "TIMESTAMP '2024-01-20 00:00:00'"
_BASE = "TIMESTAMP '2024-01-01 00:00:00'"
SPACE = r"[\s\x0B\x{85}\pZ]+"

CLAIMS = f"""claims AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'en' THEN 'Decision' ELSE 'Reference' END AS kind,
  substring(text, 1, 300) AS statement, 'repository' AS scope_kind, source AS scope_value, {_BASE} + doc_id * INTERVAL 1 MINUTE AS valid_from,
  CASE WHEN doc_id % 7 = 0 THEN {_BASE} + (doc_id + 5000) * INTERVAL 1 MINUTE END AS valid_until, {_BASE} + doc_id * INTERVAL 1 MINUTE AS recorded_at,
  CASE WHEN doc_id % 11 = 0 THEN {_BASE} + (doc_id + 9000) * INTERVAL 1 MINUTE END AS superseded_at, (doc_id % 10) / 10.0 AS confidence,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'm1' END AS extracted_by_model,
  CASE WHEN coalesce(text, '') <> '' THEN sha256(trim(regexp_replace(lower(text), '{SPACE}', ' ', 'g'))) END AS statement_sha256,
  CASE WHEN doc_id % 22 = 0 THEN 'forgotten' END AS supersede_reason, 'p' || (doc_id % 15) AS contributed_by FROM documents)"""
EVIDENCE = """evidence AS (SELECT doc_id || '-' || part AS id, CAST(doc_id AS VARCHAR) AS claim_id, source AS source_repo, 'docs/' || doc_id || part || '.md' AS source_path,
  1 AS line_start, length(text) - length(replace(text, chr(10), '')) + 1 AS line_end, text AS extracted_text
  FROM (SELECT doc_id, text, source, 'a' AS part FROM documents UNION ALL SELECT doc_id, 'see also ' || source, source, 'b' FROM documents WHERE doc_id % 4 = 0))"""
EVIDENCE_ROWS = f"""evidence_rows AS (SELECT *, CASE WHEN id LIKE '%-a' THEN CAST(CAST(claim_id AS BIGINT) % 3 AS INTEGER) END AS chunk_ordinal, sha256(extracted_text) AS content_sha256,
  CASE WHEN CAST(claim_id AS BIGINT) % 13 = 0 THEN {NOW} END AS superseded_at,
  CASE WHEN id LIKE '%-a' AND CAST(claim_id AS BIGINT) % 2 = 0 THEN 'Part ' || claim_id ELSE '' END AS anchor_symbol_path FROM evidence)"""
CLAIM_ACL = """claim_acl AS (SELECT CAST(doc_id AS VARCHAR) AS claim_id, 'p' || p AS principal_id, CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' END AS expires_at
  FROM documents, unnest(range(5)) u(p) WHERE (doc_id + p) % 3 <> 0)"""
EVIDENCE_ACL = """evidence_acl AS (SELECT id AS evidence_id, 'p' || p AS principal_id FROM evidence, unnest(range(5)) u(p) WHERE id LIKE '%-a' OR p % 2 = 0)"""
LEDGER = """ledger AS (SELECT event_id AS id, 'p' || user_id AS principal_id, 'repository' AS scope_kind, 'src' || (user_id % 4) AS scope_value,
  CASE event_type WHEN 'purchase' THEN 'inference' WHEN 'view' THEN 'recall' WHEN 'error' THEN 'denied' ELSE 'other' END AS kind,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS inference_calls, CAST(floor(abs(value) * 10) AS BIGINT) AS input_tokens,
  CAST(floor(abs(value)) AS BIGINT) AS output_tokens, ts AS recorded_at FROM events)"""
CAPTURES = """captures AS (SELECT conv_id || '-' || turn AS job_id, text AS source, conv_id, turn FROM conversations)"""
PERMITTED = f"""permitted AS (SELECT s.claim_id, s.principal_id FROM
  (SELECT claim_id, principal_id FROM claim_acl WHERE expires_at IS NULL OR {NOW} < expires_at) s
  WHERE EXISTS (SELECT 1 FROM evidence e WHERE e.claim_id = s.claim_id)
    AND NOT EXISTS (SELECT 1 FROM evidence e WHERE e.claim_id = s.claim_id
      AND NOT EXISTS (SELECT 1 FROM evidence_acl a WHERE a.evidence_id = e.id AND a.principal_id = s.principal_id)))"""


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
