import random

import numpy as np
from pyspark.sql import functions as F

from claimlake.llm import langid


def parse(training, text):
    """Greedy cross parsing, by definition."""
    n, i, phrases = len(text), 0, 0
    while i < n:
        k = 1
        while i + k < n and text[i : i + k + 1] in training:
            k += 1
        phrases, i = phrases + 1, i + k
    return phrases


def test_phrases_equal_brute_force():
    rng = random.Random(2)
    training = {n: "".join(rng.choice(a) for _ in range(400)) for n, a in (("x", "abcde "), ("y", "cdefg "))}
    judge = langid.Model(tuple((n, (t,)) for n, t in training.items()))
    squeeze = lambda s: judge.symbols(s).tolist()
    for _ in range(40):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 1500)))
        symbols = squeeze(text)
        got = judge.entropies([text])[0]
        for k, name in enumerate(judge.names):
            own = "".join(map(chr, squeeze(training[name])))
            want = sum(parse(own, "".join(map(chr, symbols[i : i + langid.BLOCK]))) for i in range(0, len(symbols), langid.BLOCK))
            assert np.isclose(got[k] * len(symbols) / judge.weight[k], want)


def test_odd_rows(odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "und")
    assert {r.doc_id: r.lang_pred for r in rows}[3] == "und"
    assert langid.identify(no_docs).count() == 0
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95


def test_every_label_is_learned_from_a_bounded_sample(spark):
    rng = random.Random(4)
    letters = [chr(0x4E00 + k) for k in range(2000)]
    own = {f"l{k:02}": [rng.choice(letters) for _ in range(30)] for k in range(70)}
    rows = [(k * 100 + i, name, "".join(rng.choice(a) for _ in range(60))) for k, (name, a) in enumerate(own.items()) for i in range(6)]
    rows += [(5, "l00", rows[5][2])] * 400
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    learned = langid.sample(docs, F.lit(True))
    assert len(learned) == 70 and all(len(x) <= 8 for x in learned.values())
    got = langid.identify(docs, F.lit(True)).join(docs.select("doc_id", "lang").distinct(), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
