"""Queries against their SQL on small tables that the driver's do not have: late clocks, ties, large keys."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from claimlake.operators import retrieval

DOCUMENTS = "doc_id bigint, text string, lang string, source string"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables by name and gives a function that holds a query against its SQL."""

    def make(**frames):
        for name, rows in frames.items():
            rows.write.parquet(f"{tmp_path}/{name}.parquet")

        def check(query):
            con = duckdb.connect()
            con.execute("SET timezone = 'UTC'")
            for name in frames:
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
            want = con.execute(__spark_entry__.oracle_sql()[query]).fetchall()
            got = [tuple(r) for r in __spark_entry__.queries()[query](spark, str(tmp_path)).collect()]
            assert sorted(map(str, got)) == sorted(map(str, want)) != []
            return got

        return check

    return make


def test_claims_recorded_after_the_clock(spark, tables):
    """The clock of the queries is 27,360 minutes after the first claim."""
    rows = spark.createDataFrame([(k, f"text {k % 9}", "en", "src1") for k in range(27_340, 27_385)], DOCUMENTS)
    check = tables(documents=rows)
    assert any(r[0] == "27384" for r in check("dedup_claims"))
    assert all(r[2] in (None, "its own successor", "already closed") for r in check("supersede"))


def test_explained_raw_scores_round_as_sql_does(spark):
    values = [n / 1e6 * s for n in range(50, 40_000_000, 99_900) for s in (1, -1)] + [-0.00001, 0.0, 1.00005, 2.67505]
    con = duckdb.connect()
    want = [con.execute("SELECT printf('%.4f', round(?::DOUBLE, 4))", [x]).fetchone()[0] for x in values]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, x double").select("k", F.format_string("%.4f", retrieval.rounded(F.col("x"), 4)).alias("t"))
    assert [r.t for r in rows.orderBy("k").collect()] == want


def test_stale_claims_read_their_texts_once_for_the_anchors(spark, tables, tmp_path):
    """Scans: claims, headings, the anchors' texts, later texts, and which of these are there. White space of all kinds, as SQL has it."""
    odd = ["\u2003", "\x1c", "\u00a0", " \u0085 ", "\t\x0b", "é"]
    check = tables(documents=spark.createDataFrame([(k, "\n".join(f"be{odd[(k + n) % 6]}n{n}{odd[n % 6]}" for n in range(k % 9)), "en", "src1") for k in range(60)], DOCUMENTS))
    assert len(check("stale_claims")) > 5
    plan = __spark_entry__.queries()["stale_claims"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 5


def test_postings_topk_moves_no_hits(spark, tables, tmp_path):
    """Frequent words, copies with equal scores and odd signs against SQL; each text is one row, whatever asks for it."""
    words = ["alpha", "beta", "the", "gamma", "Ünder", "delta2", "of"]
    rows = [(k, None if k % 17 == 5 else " ".join(words[(k // 3 * n + n) % 7] + ("-" if n % 4 else ". ") for n in range(k % 3 * 4, 14)), "en", "src1") for k in range(400)]
    vectors = spark.range(0, 400, 10).selectExpr("id AS vec_id", "array(cast(1 AS float)) AS embedding", "0 AS label")
    check = tables(documents=spark.createDataFrame(rows, DOCUMENTS), embeddings=vectors)
    assert len(check("postings_topk")) > 400
    plan = __spark_entry__.queries()["postings_topk"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 0


def test_requests_in_blocks_and_texts_in_parts(spark, monkeypatch):
    """The same from few requests and few postings at a time, from pieces of one claim in several parts, and with claims that are numbers."""
    rows = [(k % 60, f"e{k}", " ".join(f"w{(k * n) % 9}" for n in range(1, 5 + k % 6))) for k in range(300)]
    texts = spark.createDataFrame(rows, "claim_id bigint, evidence_id string, text string").repartition(5)
    asked = spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(["w1 or w2", '"w2 w4"', "w3 -w6", "w1 w5", '"w4 w8" or w7 -"w1 w2"', "none", "-w1", ""] * 3)], "query_id string, text string")
    postings = retrieval.text_postings(texts, retrieval.asked_words(asked))
    want = sorted(map(tuple, retrieval.search_texts(asked, postings, 7, 6).collect()))
    monkeypatch.setattr(retrieval, "REQUESTS", 5)
    monkeypatch.setattr(retrieval, "HELD", 1)
    assert sorted(map(tuple, retrieval.search_texts(asked, postings, 7, 6).collect())) == want and len(want) > 60
    assert sorted(map(tuple, retrieval.lexical_search(asked, retrieval.build_postings(texts), 7, 6).collect())) == want
