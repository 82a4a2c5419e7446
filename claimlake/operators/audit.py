"""Constraints as an audit: one row (table, rule, key) for each violation.

The rules on single rows are judged together: one scan of a table gives each row a mask
of the rules it breaks, and only rows that break one are taken apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import iv_well_formed
from ..functions.vectors import norm
from ..schemas import ENUMS


def audit_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """All violations in the given tables; tables and columns that are absent are not looked at."""
    out: list[DataFrame] = []
    rules: dict[str, dict[str, Column]] = {}

    def key(df: DataFrame) -> Column:
        names = [c for c in ("id", "claim_id", "evidence_id", "principal_id", "embedding_model_id") if c in df.columns]
        return F.concat_ws("/", *[F.col(c).cast("string") for c in names])

    def report(table: str, rule: str, bad: DataFrame, name: Column | None = None) -> None:
        out.append(bad.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), (key(bad) if name is None else name).alias("key")))

    def check(table: str, rule: str, columns: tuple[str, ...], wrong) -> None:
        df = tables.get(table)
        if df is not None and set(columns) <= set(df.columns):
            rules.setdefault(table, {})[rule] = F.coalesce(wrong(*[F.col(c) for c in columns]), F.lit(False))

    for (table, column), values in ENUMS.items():
        check(table, f"{column} in set", (column,), lambda c, values=values: ~c.isin(*values))
    for table in ("claims", "evidence"):
        check(table, "valid interval", ("valid_from", "valid_until"), lambda a, z: ~iv_well_formed(a, z))
        check(table, "recorded interval", ("recorded_at", "superseded_at"), lambda a, z: ~iv_well_formed(a, z))
    check("evidence", "attested by and at", ("attested_by", "attested_at"), lambda a, b: a.isNull() != b.isNull())
    check("claims", "successor needs closing", ("superseded_by", "superseded_at"), lambda a, b: a.isNotNull() & b.isNull())
    check("claims", "own successor", ("id", "superseded_by"), lambda a, b: a == b)
    check("claims", "reason needs closing", ("supersede_reason", "superseded_at"), lambda a, b: a.isNotNull() & b.isNull())
    check("claims", "confidence in [0, 1]", ("confidence",), lambda c: ~c.between(0, 1))
    check("claims", "statement not empty", ("statement",), lambda c: c == "")
    check("evidence", "lines from 1", ("line_start",), lambda c: c < 1)
    check("evidence", "lines in order", ("line_start", "line_end"), lambda a, z: z < a)
    for table, column in (("evidence", "content_sha256"), ("claims", "statement_sha256")):
        check(table, f"{column} has 32 bytes", (column,), lambda c: F.length(c) != 64)
    check("claim_embeddings", "unit length", ("embedding",), lambda v: F.abs(norm(v) - 1) > 1e-2)
    check("usage_events", "denied needs reason", ("kind", "denied_reason"), lambda k, r: (k == "denied") & r.isNull())

    for table, each in rules.items():
        df, names = tables[table], F.array(*map(F.lit, each))
        mask = sum((F.when(wrong, F.lit(1 << n)).otherwise(F.lit(0)).cast("bigint") for n, wrong in enumerate(each.values())), F.lit(0).cast("bigint"))
        broken = df.select(key(df).alias("key"), mask.alias("mask")).filter("mask != 0").withColumn("names", names)
        rule = F.expr("explode(filter(names, (x, n) -> shiftright(mask, n) & 1 = 1))")
        out.append(broken.select(F.lit(table).alias("table"), rule.alias("rule"), "key"))

    ev, models = tables.get("evidence"), tables.get("embedding_models")
    if ev is not None and "chunk_ordinal" in ev.columns:
        chunk = ["source_repo", "source_path", "chunk_ordinal"]
        twice = ev.filter("superseded_at is null and chunk_ordinal is not null").groupBy(*chunk).count().filter("count > 1")
        report("evidence", "one live chunk a place", twice, F.concat_ws("/", *[F.col(c).cast("string") for c in chunk]))
    if models is not None:
        report("embedding_models", "one model a status", models.filter("status in ('PRESENT', 'FUTURE')").groupBy("status").count().filter("count > 1"), F.col("status"))
    for table, column, parent in (
        ("claim_evidence", "claim_id", "claims"), ("claim_evidence", "evidence_id", "evidence"), ("claim_acl", "claim_id", "claims"),
        ("evidence_acl", "evidence_id", "evidence"), ("claim_embeddings", "claim_id", "claims"),
    ):
        if table in tables and parent in tables:
            ids = tables[parent].select(F.col("id").alias(column))
            report(table, f"{column} exists", tables[table].join(ids, column, "left_anti"))
    if "claims" in tables and "claim_evidence" in tables:
        linked = tables["claim_evidence"].select(F.col("claim_id").alias("id"))
        report("claims", "live claim has evidence", tables["claims"].filter("superseded_at is null").join(linked, "id", "left_anti"))
    return reduce(DataFrame.unionByName, out)
