import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, length int, rank string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    vocab = ["the", "and", "tion", "Über", "été", "x" * 30, "1", "a,b", "don't", "漢字", "#%", "é́"]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here"), (5, "a  b \n c"), (6, "y" * 5000)]
    rows += [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 90)))) for i in range(7, 40)]
    rows += [(40, " ".join(rng.choice(vocab) for _ in range(20_000))), (41, rows[20][1]), (42, rows[20][1])]
    full = [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), 1, "r") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def few_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
