"""Live tables and tables by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _live(df: DataFrame) -> DataFrame:
    return df.filter("superseded_at is null")


def live_chunks(claims: DataFrame, links: DataFrame, evidence: DataFrame, repo: str) -> DataFrame:
    """path, ordinal, claim_id, evidence_id, content_sha256 of the live seeded chunks of a repository."""
    own = _live(evidence).filter((F.col("source_repo") == repo) & F.col("chunk_ordinal").isNotNull())
    own = own.select(F.col("id").alias("evidence_id"), F.col("source_path").alias("path"), F.col("chunk_ordinal").alias("ordinal"), "content_sha256")
    ids = _live(claims).select(F.col("id").alias("claim_id"))
    return own.join(links, "evidence_id").join(ids, "claim_id").select("path", "ordinal", "claim_id", "evidence_id", "content_sha256")


def live_anchored_evidence(claims: DataFrame, links: DataFrame, evidence: DataFrame, repo: str) -> DataFrame:
    """Live evidence with an anchor, of live claims; order by path, line_start."""
    own = _live(evidence).filter((F.col("source_repo") == repo) & (F.coalesce("anchor_symbol_path", F.lit("")) != ""))
    ids = _live(claims).select(F.col("id").alias("claim_id"))
    return own.withColumnRenamed("id", "evidence_id").join(links, "evidence_id").join(ids, "claim_id")


def load_claims(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """Claims by id, live or not."""
    return claims.join(ids.select("id").distinct(), "id", "left_semi")


def load_evidence(links: DataFrame, evidence: DataFrame, claim_ids: DataFrame) -> DataFrame:
    """Evidence of claims, superseded too; order by claim_id, source_path, line_start."""
    wanted = links.join(claim_ids.select("claim_id").distinct(), "claim_id", "left_semi")
    return wanted.join(evidence, wanted["evidence_id"] == evidence["id"]).drop("id")


def load_acls(acl: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return acl.join(ids.select(key).distinct(), key, "left_semi")


def present_model(models: DataFrame, name: str | None = None) -> DataFrame:
    """The one model in use, as a row; another name than the expected one is an error."""
    present = models.filter("status = 'PRESENT'").limit(2)
    if name is None:
        return present
    wrong = F.raise_error(F.format_string("the model in use is %s", F.col("name")))
    return present.withColumn("name", F.when(F.col("name") == name, F.col("name")).otherwise(wrong.cast("string")))
