"""The registered queries over streams, as runs that end when their input does, and their SQL.

Each run writes its input in parts to the shared folder, with a run of the stream after
each part, so that it goes on from its checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import catalog, catalog_tables  # noqa: F401  whose SQL is used here
from .functions import limits
from .operators import nominate, quota, scd
from .plans import fixtures as fx
from .plans.sql import CAPTURES, CLAIMS, stamp, with_
from .registry import ORACLE_SQL, query, ts
from .sources import units
from .sources.scratch import scratch_dir, written
from .streaming import jobs, seeds, survivors


def _fresh(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/run-{uuid.uuid4().hex}"


def arriving(spark: SparkSession, parts: list[DataFrame], root: str, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Write each part and let the stream take it in."""
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{root}/in")
        jobs.with_retries(lambda s=stream: run(s))


_ARRIVALS = """live AS (SELECT id, statement_sha256 AS h, recorded_at AS t, CAST(id AS BIGINT) % 3 AS b FROM claims WHERE superseded_at IS NULL AND statement_sha256 IS NOT NULL),
latest AS (SELECT b, max(t) AS latest FROM live GROUP BY b),
least AS (SELECT h, b, min({'t': t, 'id': id}) AS least FROM live GROUP BY h, b),
after AS (SELECT h, b, min(least) OVER (PARTITION BY h ORDER BY b) AS s FROM least),
lost AS (SELECT l.id, any_value(l.h) AS h, any_value(l.t) AS t, min(a.b) AS b FROM live l JOIN after a ON a.h = l.h AND a.b >= l.b AND a.s.id <> l.id GROUP BY l.id)"""


@query(
    with_(CLAIMS, _ARRIVALS)
    + f"SELECT lost.id, after.s.id AS successor, {stamp('greatest(latest, lost.t, after.s.t)')} AS closed_at, 'duplicate' AS reason FROM lost JOIN after ON after.h = lost.h AND after.b = lost.b JOIN latest ON latest.b = lost.b"
)
def stream_closures(spark, sf):
    """Duplicates closed as claims arrive in three parts, some of them late; the survivors are kept in state."""
    root, rows = _fresh(spark), fx.claims(spark, sf)
    write = lambda df, n: units.commit(spark, root, n, {"closures": units.Change(df)})
    parts = [rows.filter(F.col("id").cast("bigint") % 3 == k) for k in range(3)]
    arriving(spark, parts, root, lambda s: survivors.stream_closures(s, write, f"{root}/cp"))
    return units.read(spark, root, "closures").select("id", "successor", ts("at", "closed_at"), "reason")


@query(ORACLE_SQL["write_claims"])
def write_unit(spark, sf):
    """Six tables that change as one unit, batch by batch; one batch is killed before its switch, and one comes twice."""
    root = _fresh(spark)
    found, _ = nominate.write_candidates(fx.candidates(spark, sf), nominate.capture_defaults(fx.captures(spark, sf)))
    rows = written(found.withColumn("prompt_version", F.lit("v1")).withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>")))
    part = F.pmod(F.xxhash64("job_id"), F.lit(2))
    for n in (0, 1, 1):
        units.commit(spark, root, n, {k: units.Change(t) for k, t in scd.write_claims(rows.filter(part == n), 1, fx.now()).items()})
        rows.limit(9).write.parquet(f"{root}/data/claims/killed-{uuid.uuid4().hex}")  # files that no manifest names
    value = {
        "claims": ("id", "statement"), "evidence": ("id", F.concat_ws(":", "source_path", "line_start")), "claim_evidence": ("claim_id", "evidence_id"),
        "claim_acl": ("claim_id", "principal_id"), "evidence_acl": ("evidence_id", "principal_id"), "claim_embeddings": ("claim_id", F.col("embedding_model_id").cast("string")),
    }
    each = [units.read(spark, root, n).select(F.lit(n).alias("table"), F.col(i).alias("id"), (F.col(v) if isinstance(v, str) else v).alias("value")) for n, (i, v) in value.items()]
    return reduce(DataFrame.unionByName, each)


_SEEDED = """chunks AS (SELECT source AS repo, 'd' || (doc_id // 4) AS path, CAST(doc_id % 4 AS INTEGER) AS ordinal, sha256(text) AS sha, n, TIMESTAMP '2024-02-01' + n * INTERVAL 1 DAY AS seen FROM
  (SELECT doc_id, source, 0 AS n, text FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL UNION ALL
   SELECT doc_id, source, 1, CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END FROM documents WHERE doc_id // 4 % 6 = 1 AND text IS NOT NULL)),
pairs AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.path, b.path) AS path, coalesce(a.ordinal, b.ordinal) AS ordinal, a.sha AS old, b.sha AS new, a.seen AS was, b.seen AS became
  FROM (SELECT * FROM chunks WHERE n = 0) a FULL JOIN (SELECT * FROM chunks WHERE n = 1) b USING (repo, path, ordinal))"""


@query(
    with_(_SEEDED)
    + f"""SELECT 'live' AS state, repo, path, ordinal, coalesce(new, old) AS content_sha256, {stamp("CASE WHEN old IS NOT DISTINCT FROM coalesce(new, old) THEN was ELSE became END")} AS recorded_at, NULL AS closed_at FROM pairs
  UNION ALL SELECT 'closed', repo, path, ordinal, old, {stamp("was")}, {stamp("became")} FROM pairs WHERE old <> new"""
)
def stream_seed(spark, sf):
    """Files seeded, and some of them again; only the buckets that hold them are written anew."""
    root, d = _fresh(spark), fx.table(spark, sf, "documents").filter("text is not null")
    key = [F.col("source").alias("repo"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 4)).alias("path"), (F.col("doc_id") % 4).cast("int").alias("ordinal")]

    def chunks(rows: DataFrame, text, day: int) -> DataFrame:
        return rows.select(*key, F.sha2(text, 256).alias("content_sha256"), F.substring(text, 1, 50).alias("statement"), F.lit(f"2024-02-0{day}").cast("timestamp").alias("ts"))

    changed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    parts = [chunks(d.filter("doc_id % 5 != 0"), F.col("text"), 1), chunks(d.filter("floor(doc_id / 4) % 6 = 1"), changed, 2)]
    arriving(spark, parts, root, lambda s: seeds.stream_seed_buckets(s, root, f"{root}/cp"))
    cols = ["repo", "path", "ordinal", "content_sha256", ts("recorded_at")]
    live = units.read(spark, root, "live").select(F.lit("live").alias("state"), *cols, F.lit(None).cast("string").alias("closed_at"))
    return live.unionByName(units.read(spark, root, "closed").select(F.lit("closed").alias("state"), *cols, ts("superseded_at", "closed_at")))


# -- gates -----------------------------------------------------------------------------------------------------------------------

_HALF_HOUR = 1_800_000_000
_GATED = "SELECT id AS event_id, CASE WHEN id % 9 = 0 THEN '' ELSE principal_id END AS principal_id, epoch_us(recorded_at) AS us, {calls} AS calls, {tokens} AS tokens FROM ledger WHERE {which}"


def _gates(spark: SparkSession, sf: str, rows: DataFrame, run) -> DataFrame:
    """The stream over rows that come in two parts, the earlier ones first."""
    root = _fresh(spark)
    half = rows.agg(F.expr("timestamp_micros(percentile_approx(unix_micros(ts), 0.5))").alias("t")).first().t
    write = lambda df, n: units.commit(spark, root, n, {"judged": units.Change(df)})

    def start(stream: DataFrame) -> StreamingQuery:
        with survivors.state_store(spark):
            return run(stream).writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()

    arriving(spark, [rows.filter(F.col("ts") <= half), rows.filter(F.col("ts") > half)], root, start)
    return units.read(spark, root, "judged")


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    who = F.when(F.col("id") % 9 == 0, "").otherwise(F.col("principal_id"))
    return fx.ledger(spark, sf).select(F.col("id").alias("event_id"), who.alias("principal_id"), F.col("recorded_at").alias("ts"), F.col("inference_calls").alias("calls"), F.col("input_tokens").alias("tokens"), "kind")


@query(
    catalog._gate_sql(
        _GATED.format(calls="CAST(inference_calls AS BIGINT)", tokens="input_tokens", which="true"), catalog._HOUR, _HALF_HOUR,
        "CASE WHEN principal_id = '' THEN NULL WHEN sc >= 2 OR stok >= 3000 THEN 'cost_ceiling' WHEN len(st) >= 3 THEN 'contribution_quota' END",
    ).replace("CASE WHEN reason IS NULL THEN list_append", "CASE WHEN reason IS NULL AND principal_id <> '' THEN list_append")
)
def stream_admission(spark, sf):
    """Z3, M7: the quota of an hour and the cost of half an hour in one state; events without a principal pass beside it."""
    cfg = limits.LimitConfig(contribution_quota=3, max_inference_calls=2, max_input_tokens=3000, cost_window=timedelta(minutes=30))
    return _gates(spark, sf, _ledger(spark, sf).drop("kind"), lambda s: jobs.stream_quota(s, cfg, "1 hour")).select("event_id", "principal_id", "denied_reason")


@query(
    catalog._gate_sql(
        _GATED.format(calls="CAST(kind = 'denied' AS BIGINT)", tokens="CAST(0 AS BIGINT)", which="id % 9 <> 0"), catalog._HOUR, catalog._HOUR,
        "CASE WHEN sc >= 2 THEN 'login_attempts' END",
    )
)
def login_gate(spark, sf):
    """M4: attempts in order; an address with two failures within the hour is denied."""
    return quota.login_gate(_attempts(spark, sf), _LOGINS).select("event_id", F.col("email").alias("principal_id"), "denied_reason")


_LOGINS = limits.LimitConfig(max_login_attempts=2, login_window=timedelta(hours=1))


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ledger(spark, sf).filter("principal_id != ''")
    return rows.select("event_id", F.col("principal_id").alias("email"), "ts", (F.col("kind") != "denied").alias("succeeded"))


@query(ORACLE_SQL["login_gate"])
def stream_logins(spark, sf):
    """Z3, M4: the same as a stream."""
    return _gates(spark, sf, _attempts(spark, sf), lambda s: jobs.stream_login_gate(s, _LOGINS, "1 hour")).select("event_id", F.col("email").alias("principal_id"), "denied_reason")


@query(ORACLE_SQL["recall_gate"])
def stream_recalls(spark, sf):
    """Z3, M8: the recall rate as a stream."""
    cfg = limits.LimitConfig(recall_rate=5, recall_window=timedelta(hours=1))
    rows = fx.ledger(spark, sf).filter("kind = 'recall'").select(F.col("id").alias("event_id"), F.concat(F.lit("u"), F.col("id") % 40).alias("principal_id"), F.col("recorded_at").alias("ts"))
    return _gates(spark, sf, rows, lambda s: jobs.stream_recall_gate(s, cfg, "1 hour")).select("event_id", "principal_id", "denied_reason")
