"""Access control: a principal reads a claim if every access list on it, and on all its evidence, names them.

Empty lists and claims without evidence admit nobody; denial is a missing row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(expires_at: Column, now: Column) -> Column:
    return expires_at.isNull() | (now < expires_at)


def active_principals(acl: DataFrame, key: str, now: Column) -> DataFrame:
    """Distinct (key, principal_id) whose grant has not expired."""
    return acl.filter(active(F.col("expires_at"), now)).select(key, "principal_id").distinct()


def intersect_acls(sets: DataFrame, members: DataFrame) -> DataFrame:
    """``sets`` (group_id, set_id) and ``members`` (set_id, principal_id): principals in every set of a group.

    A group without sets has no row in ``sets`` and admits nobody.
    """
    wanted = sets.distinct().groupBy("group_id").agg(F.count("*").alias("need"))
    held = sets.distinct().join(members.distinct(), "set_id").groupBy("group_id", "principal_id").agg(F.count("*").alias("have"))
    return held.join(wanted, "group_id").filter("have = need").select("group_id", "principal_id")


def permitted(claims: DataFrame, links: DataFrame, claim_acl: DataFrame, evidence_acl: DataFrame, now: Column) -> DataFrame:
    """(claim_id, principal_id) of who may read each claim in ``claims`` (claim_id).

    Relational division by counting: one list for the claim and one for each piece of
    evidence, superseded evidence included.
    """
    links = links.select("claim_id", "evidence_id").distinct().join(claims.select("claim_id").distinct(), "claim_id", "left_semi")
    need = links.groupBy("claim_id").agg((F.count("*") + 1).alias("need"))
    own = active_principals(claim_acl, "claim_id", now).withColumn("n", F.lit(1).cast("bigint"))
    by_evidence = active_principals(evidence_acl, "evidence_id", now).join(links, "evidence_id")
    by_evidence = by_evidence.groupBy("claim_id", "principal_id").agg(F.count("*").alias("n"))
    have = own.unionByName(by_evidence).groupBy("claim_id", "principal_id").agg(F.sum("n").alias("have"), F.count("*").alias("kinds"))
    return have.join(need, "claim_id").filter("have = need and kinds = 2").select("claim_id", "principal_id")


def acl_filter(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of ``hits`` (claim_id, principal_id, ...) that the principal may read, order columns untouched."""
    return hits.join(allowed, ["claim_id", "principal_id"], "left_semi")
