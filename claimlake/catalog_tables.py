"""The registered queries over sources, transitions and constraints, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import CFG, window_state
from .functions import intervals, text, vectors
from .operators import audit, nominate, reports, scd
from .plans import fixtures as fx
from .plans.sql import CAPTURES, CLAIM_ACL, CLAIMS, EVIDENCE, EVIDENCE_ACL, EVIDENCE_ROWS, LEDGER, with_
from .registry import ORACLE_SQL, query, ts
from .sources import claims as live

# -- sources ---------------------------------------------------------------------------------------------------------------------

_ROWS = (CLAIMS, EVIDENCE, EVIDENCE_ROWS)


@query(
    with_(*_ROWS)
    + "SELECT e.source_path AS path, chunk_ordinal AS ordinal, e.claim_id, e.id AS evidence_id, content_sha256 FROM evidence_rows e JOIN claims c ON c.id = e.claim_id "
    "WHERE e.superseded_at IS NULL AND c.superseded_at IS NULL AND chunk_ordinal IS NOT NULL AND e.source_repo = 'src2'"
)
def live_chunks(spark, sf):
    """Live seeded chunks of a repository."""
    return live.live_chunks(fx.claims(spark, sf), fx.links(spark, sf), fx.evidence_rows(spark, sf), "src2")


@query(
    with_(*_ROWS)
    + "SELECT e.claim_id, e.id AS evidence_id, source_path, anchor_symbol_path FROM evidence_rows e JOIN claims c ON c.id = e.claim_id "
    "WHERE e.superseded_at IS NULL AND c.superseded_at IS NULL AND anchor_symbol_path <> '' AND e.source_repo = 'src4'"
)
def live_anchored_evidence(spark, sf):
    """A4: live evidence with an anchor, of live claims."""
    out = live.live_anchored_evidence(fx.claims(spark, sf), fx.links(spark, sf), fx.evidence_rows(spark, sf), "src4")
    return out.select("claim_id", "evidence_id", "source_path", "anchor_symbol_path")


@query(with_(CLAIMS, EVIDENCE) + "SELECT id, superseded_at IS NULL AS live FROM claims WHERE id IN (SELECT claim_id FROM evidence WHERE id LIKE '%-b')")
def load_claims(spark, sf):
    """A5: claims by id, here those with a second piece of evidence, live or not."""
    ids = fx.links(spark, sf).filter("evidence_id like '%-b'").select(F.col("claim_id").alias("id"))
    return live.load_claims(fx.claims(spark, sf), ids).select("id", F.col("superseded_at").isNull().alias("live"))


@query(with_(CLAIMS, EVIDENCE) + "SELECT claim_id, id AS evidence_id, source_path FROM evidence")
def load_evidence(spark, sf):
    """Evidence of all claims."""
    wanted = fx.claims(spark, sf).select(F.col("id").alias("claim_id"))
    return live.load_evidence(fx.links(spark, sf), fx.evidence(spark, sf).drop("claim_id"), wanted).select("claim_id", "evidence_id", "source_path")


@query(
    with_(EVIDENCE, CLAIM_ACL, EVIDENCE_ACL)
    + "SELECT claim_id AS id, principal_id FROM claim_acl WHERE claim_id IN (SELECT claim_id FROM evidence WHERE source_repo = 'src3') "
    "UNION ALL SELECT evidence_id, principal_id FROM evidence_acl WHERE evidence_id IN (SELECT id FROM evidence WHERE source_repo = 'src3')"
)
def load_acls(spark, sf):
    """Grants on the claims and on the evidence of a repository."""
    e = fx.evidence(spark, sf).filter("source_repo = 'src3'")
    by_claim = live.load_acls(fx.claim_acl(spark, sf), "claim_id", e.select("claim_id")).select(F.col("claim_id").alias("id"), "principal_id")
    by_evidence = live.load_acls(fx.evidence_acl(spark, sf), "evidence_id", e.select(F.col("id").alias("evidence_id"))).select(F.col("evidence_id").alias("id"), "principal_id")
    return by_claim.unionByName(by_evidence)


def _models(spark, sf) -> DataFrame:
    n = fx.table(spark, sf, "nation")
    status = F.when(F.col("n_nationkey") == 3, "PRESENT").when(F.col("n_nationkey") == 4, "FUTURE").otherwise("RETIRED")
    return n.select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"), status.alias("status"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name FROM nation WHERE n_nationkey = 3")
def present_model(spark, sf):
    """The one model in use."""
    return live.present_model(_models(spark, sf)).select("id", "name")


@query(with_(*_ROWS) + "SELECT id, CASE WHEN anchor_symbol_path <> '' THEN 'anchored' ELSE 'unanchored' END AS anchor_state FROM evidence_rows")
def anchor_state(spark, sf):
    """Whether a piece of evidence has an anchor."""
    return reports.evidence_anchor_state(fx.evidence_rows(spark, sf)).select("id", "anchor_state")


@query("SELECT 'c' || c_custkey AS principal_id, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, '') AS role FROM customer")
def role_of(spark, sf):
    """The role of each principal, blank without credentials."""
    c = fx.table(spark, sf, "customer")
    who = F.concat(F.lit("c"), "c_custkey").alias("principal_id")
    return reports.role_of(c.select(who), c.filter("c_custkey % 3 != 0").select(who, F.col("c_mktsegment").alias("role")))


_EXT = ("go", "PY", "tsx", "rs", "h", "cpp", "md", "kt", "", "html")


@query(
    f"""SELECT doc_id, CASE WHEN ext IN ('', 'md') THEN 'document' ELSE 'code' END AS kind, coalesce(MAP {{'go': 'go', 'PY': 'py', 'tsx': 'jsts', 'rs': 'rust', 'h': 'c', 'cpp': 'cpp', 'kt': 'kotlin', 'html': 'html'}}[ext], '') AS lang
  FROM (SELECT doc_id, {list(_EXT)}[CAST(doc_id % 10 AS INTEGER) + 1] AS ext FROM documents)"""
)
def path_kinds(spark, sf):
    """Kind and language of a path by its extension."""
    ext = F.get(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % 10).cast("int"))
    path = F.concat(F.lit("a.b/"), F.col("doc_id"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    return fx.table(spark, sf, "documents").select("doc_id", text.kind_for_path(path).alias("kind"), text.lang_of(path).alias("lang"))


# -- transitions -----------------------------------------------------------------------------------------------------------------

_SEED = ORACLE_SQL["seed_merge"]


@query(
    "SELECT count(DISTINCT CASE WHEN action IN ('inserted', 'unchanged') THEN repo || '/' || path END) AS files, count(*) FILTER (WHERE action IN ('inserted', 'unchanged')) AS chunks, "
    "count(*) FILTER (WHERE action = 'inserted') AS inserted, count(*) FILTER (WHERE action = 'superseded') AS superseded, count(*) FILTER (WHERE action = 'unchanged') AS unchanged FROM ("
    + _SEED + ")"
)
def seed_report(spark, sf):
    """B2: what a re-seeding did, in one row."""
    from .catalog import seed_merge

    return scd.seed_report(seed_merge(spark, sf))


@query(
    "SELECT sha256(concat_ws(chr(31), source, 'd' || doc_id, '0', sha256(text))) AS id, 'Reference' AS kind, 'd' || doc_id AS scope_value, CAST(0.5 AS DOUBLE) AS confidence, source AS source_repo FROM documents WHERE text IS NOT NULL"
)
def seed_claims(spark, sf):
    """The claims of seeded chunks, with their defaults."""
    d = fx.table(spark, sf, "documents").filter("text is not null")
    chunks = d.select(F.col("source").alias("repo"), F.concat(F.lit("d"), "doc_id").alias("path"), F.lit(0).alias("ordinal"), F.col("text").alias("statement"), F.sha2("text", 256).alias("content_sha256"))
    return scd.seed_claim_defaults(chunks, fx.now()).select("id", "kind", "scope_value", "confidence", "source_repo")


@query(
    with_(CAPTURES)
    + """, good AS (SELECT job_id, statement, path, line, conv_id FROM (SELECT conv_id, job_id, conv_id || '/' || turn || '.txt' AS path, source, length(source) AS k, substring(source, 11, 40) AS quote, substring(source, 1, 80) AS statement,
    1 + length(source[:strpos(source, substring(source, 11, 40)) - 1]) - length(replace(source[:strpos(source, substring(source, 11, 40)) - 1], chr(10), '')) AS line FROM captures WHERE trim(source) <> '')
    WHERE k % 4 <> 0 AND k % 9 <> 0 AND k % 13 <> 0 AND trim(quote) <> '' AND trim(statement) <> ''),
  ids AS (SELECT *, sha256(concat_ws(chr(31), job_id, statement, path, CAST(line AS VARCHAR))) AS claim_id FROM good)
  SELECT 'claims' AS "table", claim_id AS id, statement AS value FROM ids UNION ALL SELECT 'evidence', sha256(concat_ws(chr(31), claim_id, 'evidence')), path || ':' || line FROM ids
  UNION ALL SELECT 'claim_evidence', claim_id, sha256(concat_ws(chr(31), claim_id, 'evidence')) FROM ids UNION ALL SELECT 'claim_acl', claim_id, 'p' || (conv_id % 5) FROM ids
  UNION ALL SELECT 'evidence_acl', sha256(concat_ws(chr(31), claim_id, 'evidence')), 'p' || (conv_id % 5) FROM ids UNION ALL SELECT 'claim_embeddings', claim_id, '1' FROM ids"""
)
def write_claims(spark, sf):
    """Located candidates as the rows of six tables."""
    found, _ = nominate.write_candidates(fx.candidates(spark, sf), nominate.capture_defaults(fx.captures(spark, sf)))
    rows = found.withColumn("prompt_version", F.lit("v1")).withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>"))
    t = scd.write_claims(rows, 1, fx.now())
    value = {
        "claims": ("id", "statement"), "evidence": ("id", F.concat_ws(":", "source_path", "line_start")), "claim_evidence": ("claim_id", "evidence_id"),
        "claim_acl": ("claim_id", "principal_id"), "evidence_acl": ("evidence_id", "principal_id"), "claim_embeddings": ("claim_id", F.col("embedding_model_id").cast("string")),
    }
    each = [t[n].select(F.lit(n).alias("table"), F.col(i).alias("id"), (F.col(v) if isinstance(v, str) else v).alias("value")) for n, (i, v) in value.items()]
    return reduce(DataFrame.unionByName, each)


@query(with_(LEDGER) + "SELECT kind, count(*) AS n, CAST(sum(CASE WHEN kind = 'inference' THEN 1 ELSE 0 END) AS BIGINT) AS calls FROM ledger GROUP BY kind")
def record_usage(spark, sf):
    """A ledger with later events appended; an inference counts one call."""
    rows = fx.ledger(spark, sf)
    early = F.col("id") % 2 == 0
    out = scd.record_usage(rows.filter(early), rows.filter(~early).drop("inference_calls"))
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum("inference_calls").alias("calls"))


@query(
    """SELECT id, a < z AS well_formed, a < b + INTERVAL 2 DAY AND b < z AS overlaps, z = b AS meets FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate AS a,
  l_shipdate + CAST(l_linenumber - 1 AS INTEGER) * INTERVAL 1 DAY AS z, l_shipdate + CAST(l_partkey % 5 AS INTEGER) * INTERVAL 1 DAY AS b FROM lineitem)"""
)
def interval_relations(spark, sf):
    """Intervals of shipping against others."""
    day = lambda c: F.make_dt_interval(c.cast("int"))
    a = F.col("l_shipdate").cast("timestamp")
    z, b = a + day(F.col("l_linenumber") - 1), a + day(F.col("l_partkey") % 5)
    return fx.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), intervals.iv_well_formed(a, z).alias("well_formed"),
        intervals.iv_overlaps(a, z, b, b + F.expr("interval 2 days")).alias("overlaps"), intervals.iv_meets(z, b).alias("meets"),
    )


@query(
    ORACLE_SQL["usage_report"].replace("allowed, CAST(greatest(3", "CASE WHEN contributions >= 3 THEN 'contribution_quota' END AS reason, CAST(greatest(3", 1)
    .replace("calls < 5 AND tokens < 20000, ", "CASE WHEN calls >= 5 OR tokens >= 20000 THEN 'cost_ceiling' END, ", 1)
    .replace("recalls < 5, ", "CASE WHEN recalls >= 5 THEN 'recall_rate' END, ", 1).replace("contributions < 3 AS ", "", 1)
)
def denial_reasons(spark, sf):
    """Why a gate is shut."""
    return reports.usage_report(window_state(spark, sf), CFG).select("principal_id", "gate", "reason", "remaining")


# -- models ----------------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, round(n / sqrt(n * n + 25.0), 3) AS x, round(3.0 / sqrt(n * n + 25.0), 3) AS y FROM (SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS n FROM documents)")
def embed_texts(spark, sf):
    """Embeddings from a callable, brought to unit length."""
    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    v = nominate.embed_texts(d, lambda texts: [[float(len(t)), 3.0, 4.0] for t in texts])
    part = lambda k: F.round(F.get("embedding", F.lit(k)).cast("double"), 3)
    return v.select("doc_id", part(0).alias("x"), part(1).alias("y"))


@query(f"SELECT job_id, CAST(length(prompt) AS VARCHAR) AS raw, CAST(length(prompt) // 4 AS INTEGER) AS input_tokens FROM ({ORACLE_SQL['build_prompts']})")
def nominate_claims(spark, sf):
    """The responses of a model, here a callable that gives a prompt's length."""

    def generate(prompts: list[str]) -> list[dict]:
        return [{"raw": str(len(p)), "stop_reason": "stop", "input_tokens": len(p) // 4, "output_tokens": 1, "wall_ms": 1} for p in prompts]

    return nominate.nominate(fx.captures(spark, sf), generate).select("job_id", "raw", "input_tokens")


# -- audit -----------------------------------------------------------------------------------------------------------------------

_K = "CAST(id AS BIGINT)"
_AUDITED = f"""c AS (SELECT * REPLACE (CASE WHEN {_K} % 50 = 1 THEN 1.5 ELSE confidence END AS confidence, CASE WHEN {_K} % 60 = 2 THEN 'Rumour' ELSE kind END AS kind,
    CASE WHEN {_K} % 70 = 3 THEN valid_from ELSE valid_until END AS valid_until, CASE WHEN {_K} % 130 = 13 THEN recorded_at ELSE superseded_at END AS superseded_at,
    CASE WHEN {_K} % 120 = 17 THEN 'pruned' ELSE supersede_reason END AS supersede_reason), CASE WHEN {_K} % 110 = 9 THEN id WHEN {_K} % 100 = 7 THEN 'x' END AS superseded_by FROM claims),
  e AS (SELECT *, CAST(claim_id AS BIGINT) AS o FROM evidence_rows WHERE CAST(claim_id AS BIGINT) % 80 <> 4),
  f AS (SELECT id, CASE WHEN o % 140 = 15 THEN 'p1' END AS attested_by, CASE WHEN o % 150 = 18 THEN 0 ELSE line_start END AS line_start, CASE WHEN o % 160 = 19 THEN -1 ELSE line_end END AS line_end,
    CASE WHEN o % 170 = 21 THEN 'abc' ELSE content_sha256 END AS content_sha256, CASE WHEN o % 30 = 23 THEN 'docs/twice.md' ELSE source_path END AS source_path, source_repo, superseded_at,
    CASE WHEN o % 30 = 23 THEN 0 ELSE chunk_ordinal END AS chunk_ordinal FROM e)"""


@query(
    with_(*_ROWS, EVIDENCE_ACL, LEDGER, _AUDITED)
    + """SELECT 'claims' AS "table", 'confidence in [0, 1]' AS rule, id AS key FROM c WHERE confidence > 1
  UNION ALL SELECT 'claims', 'kind in set', id FROM c WHERE kind = 'Rumour'
  UNION ALL SELECT 'claims', 'valid interval', id FROM c WHERE valid_until <= valid_from
  UNION ALL SELECT 'claims', 'recorded interval', id FROM c WHERE superseded_at <= recorded_at
  UNION ALL SELECT 'claims', 'successor needs closing', id FROM c WHERE superseded_by IS NOT NULL AND superseded_at IS NULL
  UNION ALL SELECT 'claims', 'own successor', id FROM c WHERE superseded_by = id
  UNION ALL SELECT 'claims', 'reason needs closing', id FROM c WHERE superseded_at IS NULL AND supersede_reason IS NOT NULL
  UNION ALL SELECT 'claims', 'statement not empty', id FROM c WHERE statement = ''
  UNION ALL SELECT 'claims', 'live claim has evidence', id FROM c WHERE superseded_at IS NULL AND CAST(id AS BIGINT) % 90 = 5
  UNION ALL SELECT 'evidence', 'attested by and at', id FROM f WHERE attested_by IS NOT NULL
  UNION ALL SELECT 'evidence', 'lines from 1', id FROM f WHERE line_start < 1
  UNION ALL SELECT 'evidence', 'lines in order', id FROM f WHERE line_end < line_start
  UNION ALL SELECT 'evidence', 'content_sha256 has 32 bytes', id FROM f WHERE length(content_sha256) <> 64
  UNION ALL SELECT 'evidence', 'one live chunk a place', source_repo || '/' || source_path || '/' || chunk_ordinal FROM f WHERE superseded_at IS NULL AND chunk_ordinal IS NOT NULL
    GROUP BY source_repo, source_path, chunk_ordinal HAVING count(*) > 1
  UNION ALL SELECT 'claim_evidence', 'evidence_id exists', claim_id || '/' || id FROM evidence WHERE CAST(claim_id AS BIGINT) % 90 <> 5 AND CAST(claim_id AS BIGINT) % 80 = 4
  UNION ALL SELECT 'evidence_acl', 'evidence_id exists', evidence_id || '/' || principal_id FROM evidence_acl WHERE CAST(string_split(evidence_id, '-')[1] AS BIGINT) % 80 = 4
  UNION ALL SELECT 'claim_embeddings', 'unit length', vec_id || '/1' FROM embeddings WHERE vec_id % 50 = 0
  UNION ALL SELECT 'claim_embeddings', 'claim_id exists', vec_id || '/1' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'embedding_models', 'one model a status', 'PRESENT' FROM (SELECT 1)
  UNION ALL SELECT 'usage_events', 'kind in set', id || '/' || principal_id FROM ledger WHERE kind = 'other'
  UNION ALL SELECT 'usage_events', 'denied needs reason', id || '/' || principal_id FROM ledger WHERE kind = 'denied' AND id % 3 = 0"""
)
def audit_constraints(spark, sf):
    """Q1 to Q13 over tables with violations of each planted."""
    k, owner = F.col("id").cast("bigint"), F.split("id", "-")[0].cast("bigint")
    c = fx.claims(spark, sf)
    c = c.withColumns({
        "confidence": F.when(k % 50 == 1, 1.5).otherwise(F.col("confidence")), "kind": F.when(k % 60 == 2, "Rumour").otherwise(F.col("kind")),
        "valid_until": F.when(k % 70 == 3, F.col("valid_from")).otherwise(F.col("valid_until")), "superseded_at": F.when(k % 130 == 13, F.col("recorded_at")).otherwise(F.col("superseded_at")),
        "supersede_reason": F.when(k % 120 == 17, "pruned").otherwise(F.col("supersede_reason")), "superseded_by": F.when(k % 110 == 9, F.col("id")).when(k % 100 == 7, "x"),
    })
    e = fx.evidence_rows(spark, sf).filter(owner % 80 != 4)
    e = e.withColumns({
        "attested_by": F.when(owner % 140 == 15, "p1"), "attested_at": F.lit(None).cast("timestamp"), "line_start": F.when(owner % 150 == 18, 0).otherwise(F.col("line_start")),
        "line_end": F.when(owner % 160 == 19, -1).otherwise(F.col("line_end")), "content_sha256": F.when(owner % 170 == 21, "abc").otherwise(F.col("content_sha256")),
        "source_path": F.when(owner % 30 == 23, "docs/twice.md").otherwise(F.col("source_path")), "chunk_ordinal": F.when(owner % 30 == 23, 0).otherwise(F.col("chunk_ordinal")),
    })
    unit = vectors.l2_normalize(F.col("embedding"))
    v = fx.table(spark, sf, "embeddings").select(F.lit(1).alias("embedding_model_id"), F.col("vec_id").cast("string").alias("claim_id"), F.when(F.col("vec_id") % 50 == 0, F.transform(unit, lambda x: x * 2)).otherwise(unit).alias("embedding"))
    models = _models(spark, sf).withColumn("status", F.when(F.col("id") == 7, "PRESENT").otherwise(F.col("status")))
    events = fx.ledger(spark, sf).withColumn("denied_reason", F.when((F.col("kind") == "denied") & (F.col("id") % 3 != 0), "x"))
    links = fx.links(spark, sf).filter(F.col("claim_id").cast("bigint") % 90 != 5)
    return audit.audit_constraints({
        "claims": c, "evidence": e, "claim_evidence": links, "evidence_acl": fx.evidence_acl(spark, sf), "claim_embeddings": v, "embedding_models": models, "usage_events": events,
    })
