"""The logical tables, derived from the driver tables with plain Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import STOP_WORDS

#: The clock of all registered queries.
NOW = "2024-01-20 00:00:00"
BASE = "2024-01-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """A claim for each document: recorded doc_id minutes after BASE, some closed, some expired."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    at = F.expr(f"timestamp'{BASE}' + make_interval(0,0,0,0,0,cast(doc_id as int))")
    none = F.lit(None).cast("string")
    return d.select(
        k.cast("string").alias("id"), F.when(F.col("lang") == "en", "Decision").otherwise("Reference").alias("kind"), F.substring("text", 1, 300).alias("statement"),
        F.lit("repository").alias("scope_kind"), F.col("source").alias("scope_value"), at.alias("valid_from"),
        F.when(k % 7 == 0, F.expr(f"timestamp'{BASE}' + make_interval(0,0,0,0,0,cast(doc_id + 5000 as int))")).alias("valid_until"), at.alias("recorded_at"),
        F.when(k % 11 == 0, F.expr(f"timestamp'{BASE}' + make_interval(0,0,0,0,0,cast(doc_id + 9000 as int))")).alias("superseded_at"), none.alias("superseded_by"),
        ((k % 10) / 10.0).alias("confidence"), F.col("source").alias("source_repo"), F.when(k % 3 == 0, "").otherwise("m1").alias("extracted_by_model"),
        F.when(F.coalesce("text", F.lit("")) != "", F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"[\s\u0085\p{Z}]+", " ")), 256)).alias("statement_sha256"),
        F.when(k % 11 == 0, F.when(k % 2 == 0, "forgotten")).alias("supersede_reason"), F.concat(F.lit("p"), k % 15).alias("contributed_by"),
    )


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """One piece of evidence for each document, and a second one, with another text, for every fourth."""
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    second = d.filter("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("see also "), F.col("source")).alias("text"), "source", F.lit("b").alias("part"))
    both = d.withColumn("part", F.lit("a")).unionByName(second)
    return both.select(
        F.concat(F.col("doc_id"), F.lit("-"), F.col("part")).alias("id"), F.col("doc_id").cast("string").alias("claim_id"), F.col("source").alias("source_repo"),
        F.concat(F.lit("docs/"), F.col("doc_id"), F.col("part"), F.lit(".md")).alias("source_path"), F.lit(1).alias("line_start"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("line_end"), F.col("text").alias("extracted_text"),
    )


def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``evidence`` with places, hashes and anchors: first pieces are seeded chunks, every thirteenth is superseded, every second has an anchor."""
    k = F.col("claim_id").cast("bigint")
    first = F.col("id").endswith("-a")
    return evidence(spark, sf).withColumns({
        "chunk_ordinal": F.when(first, (k % 3).cast("int")), "content_sha256": F.sha2("extracted_text", 256), "superseded_at": F.when(k % 13 == 0, now()),
        "anchor_symbol_path": F.when(first & (k % 2 == 0), F.concat(F.lit("Part "), k)).otherwise(""),
    }).drop("claim_id")


def links(spark: SparkSession, sf: str) -> DataFrame:
    return evidence(spark, sf).select("claim_id", F.col("id").alias("evidence_id"))


def claim_acl(spark: SparkSession, sf: str) -> DataFrame:
    """Principals p0 to p4 by (doc_id + p) mod 3; grants of every fifth document end early."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("p")).filter("(doc_id + p) % 3 != 0")
    ends = F.when(F.col("doc_id") % 5 == 0, F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return d.select(F.col("doc_id").cast("string").alias("claim_id"), F.concat(F.lit("p"), F.col("p")).alias("principal_id"), ends.alias("expires_at"))


def evidence_acl(spark: SparkSession, sf: str) -> DataFrame:
    """All five principals on first evidence, the even ones on second."""
    e = evidence(spark, sf).select("id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("p")).filter("id like '%-a' or p % 2 = 0")
    return e.select(F.col("id").alias("evidence_id"), F.concat(F.lit("p"), F.col("p")).alias("principal_id"), F.lit(None).cast("timestamp").alias("expires_at"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("claim_id"), "embedding")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth vector as a request; its text is made of words of the document of that number, if there is one.

    By turns two words of which one must be there, a phrase, a word without another, and two words.
    """
    e, d = table(spark, sf, "embeddings").filter("vec_id % 20 = 0"), table(spark, sf, "documents")
    words = F.split(F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " ")), " ")
    both = e.join(d, e["vec_id"] == d["doc_id"], "left").select("vec_id", "embedding", words.alias("w"), F.filter(words, lambda x: (x != "") & ~x.isin(*STOP_WORDS)).alias("ws"))
    a, b, turn = F.get("ws", F.lit(0)), F.get("ws", F.lit(1)), F.floor(F.col("vec_id") / 20) % 4
    phrase = F.concat(F.lit('"'), F.get("w", F.lit(3)), F.lit(" "), F.get("w", F.lit(4)), F.lit('"'))
    asked = F.when(turn == 0, F.concat_ws(" or ", a, b)).when(turn == 1, phrase).when(turn == 2, F.concat_ws(" -", a, b)).otherwise(F.concat_ws(" ", a, b))
    large = F.floor(F.col("vec_id") / 20) % 3 == 0
    return both.select(
        F.col("vec_id").alias("query_id"), F.concat(F.lit("p"), F.floor(F.col("vec_id") / 20) % 5).alias("principal_id"), F.coalesce(asked, F.lit("")).alias("text"),
        F.col("embedding").alias("vec"), F.when(large, 80).otherwise(5).alias("limit"), F.when(large, 20_000).otherwise(3000).cast("bigint").alias("budget"), now().alias("now"),
    )


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Usage events: purchases are inferences, views recalls, errors denials."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "purchase", "inference").when(F.col("event_type") == "view", "recall").when(F.col("event_type") == "error", "denied").otherwise("other")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("p"), F.col("user_id")).alias("principal_id"), F.lit("repository").alias("scope_kind"),
        F.concat(F.lit("src"), F.col("user_id") % 4).alias("scope_value"), kind.alias("kind"), F.when(kind == "inference", 1).otherwise(0).alias("inference_calls"),
        F.floor(F.abs("value") * 10).cast("bigint").alias("input_tokens"), F.floor(F.abs("value")).cast("bigint").alias("output_tokens"), F.col("ts").cast("timestamp").alias("recorded_at"),
    )


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with headings and fences put before every third line."""
    d = table(spark, sf, "documents").filter(F.col("text").isNotNull())
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("# Part "), i, F.lit("\n"), x)).when(i % 5 == 2, F.concat(F.lit("## Sub "), i, F.lit("\n"), x))
        .when(i % 7 == 3, F.concat(F.lit("```\n# no heading\n"), x, F.lit("\n```"))).otherwise(x),
    )
    return d.select(F.col("source").alias("repo"), F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".md")).alias("path"), F.array_join(lines, "\n").alias("text"))


def fenced(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' words, one a line, with a heading before every 97th and a fence before every 61st."""
    d = table(spark, sf, "documents").filter(F.col("text").isNotNull())
    words = F.filter(F.split("text", r"[^a-zA-Z]+"), lambda x: x != "")
    lines = F.transform(words, lambda x, i: F.when(i % 97 == 0, F.concat(F.lit("# Part "), i, F.lit("\n"), x)).when(i % 61 == 7, F.concat(F.lit("```\n"), x)).otherwise(x))
    return d.select(F.col("source").alias("repo"), F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".md")).alias("path"), F.array_join(lines, "\n").alias("text"))


def captures(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("job_id"), F.col("text").alias("source"), F.lit("document").alias("source_kind"), F.lit("chats").alias("repo"),
        F.concat(F.col("conv_id"), F.lit("/"), F.col("turn"), F.lit(".txt")).alias("path"), F.lit(1).alias("base_line"), F.lit("repository").alias("scope_kind"),
        F.lit("").alias("scope_value"), F.array(F.concat(F.lit("p"), F.col("conv_id") % 5)).alias("principals"), F.lit("turn").alias("trigger"),
        F.expr(f"timestamp'{BASE}' + make_interval(0,0,0,0,0,cast(conv_id as int),cast(turn as int))").alias("ts"),
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """A candidate a turn: a quote from its text, or one that is not there, and some that the gate drops."""
    c = captures(spark, sf)
    k = F.length("source")
    return c.select(
        "job_id", F.when(k % 9 == 0, "Rumour").otherwise("Decision").alias("kind"), F.substring("source", 1, 80).alias("statement"),
        F.when(k % 4 == 0, "this is nowhere").otherwise(F.substring("source", 11, 40)).alias("quote"),
        F.when(k % 13 == 0, F.lit(1.7)).otherwise(F.lit(0.6)).alias("confidence"),
    )
