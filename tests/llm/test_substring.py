import hashlib
import random

import numpy as np
import pytest

from claimlake.llm import substring


def brute(rows, window=substring.WINDOW):
    """{row number: (n_words, n_removed, sha)} by a table of all windows."""
    split = [(t or "").encode().split() for _, t in rows]
    last = (1 << 63) - 1
    ids = [last if d is None else d for d, _ in rows]
    first = {}
    for d, w in zip(ids, split):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in zip(ids, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((rows[len(out)][0], len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(map(str, out))


def made(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(15, 70))] for _ in range(5)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randint(1, 50))]
            if rng.random() < 0.1:
                w += ["same"] * rng.randint(1, 90)
        rows.append((d if rng.random() < 0.95 else rng.randint(0, n), rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1]), rows[4], (None, rows[5][1]), (None, None), (n + 3, "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [0, 3, 10**9])
def test_digest_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    rows = made(hot % 7, 120)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(str(tuple(r)) for r in substring.digest(docs).collect())
    assert got == brute(rows)


def test_documents(few_docs, odd_docs, no_docs):
    for docs in (few_docs, odd_docs):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(str(tuple(r)) for r in substring.digest(docs).collect()) == brute(rows)
        novel = substring.keep_novel(docs)
        assert novel.columns == docs.columns
        kept = {(r[0], r[2], r[3]) for r in map(tuple, substring.digest(docs).collect())}
        left = {(r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in novel.collect()}
        assert {(d, s) for d, _, s in kept} == left
    assert substring.digest(no_docs).count() == 0


def test_index_equals_scan():
    rng = np.random.default_rng(1)
    for depth, sigma in ((4, 3), (5, 9), (20, 2), (7, 40)):
        text = np.append(rng.integers(1, sigma + 1, 400), 0)
        text[::57] = 0
        index = substring.FMIndex(text, depth)
        ends = np.arange(depth - 1, len(text))
        took, first = index.match(ends)
        grams = {}
        for i in range(len(text) - depth + 1):
            grams.setdefault(tuple(text[i : i + depth]), []).append(i)
        for e, t, f in zip(ends, took, first):
            g = tuple(text[e - depth + 1 : e + 1])
            if 0 in g:
                continue
            assert (t == depth) == (len(grams[g]) > 1)
            assert f == (grams[g][0] if t == depth else -1)


def test_names_of_columns_do_not_clash(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, 5, "a", "x", 3), (2, "new " + text, 6, "b", "y", 4)], "doc_id bigint, text string, _id bigint, _th string, id string, start int")
    rows = {r.doc_id: r for r in substring.keep_novel(docs).collect()}
    assert rows[1].text == text and rows[2].text == "new" and [(r._id, r._th, r.id, r.start) for r in (rows[1], rows[2])] == [(5, "a", "x", 3), (6, "b", "y", 4)]


def test_texts_without_or_with_one_id(spark):
    """Many texts share a null id, or one id; the passage that they have in common starts first in document 1."""
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(1, passage)] + [(None, f"n{k} m{k} {passage} e{k}") for k in range(200)] + [(7, f"a{k} b{k} {passage}") for k in range(substring.SHARED + 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for ids in (docs, docs.filter("doc_id is null or doc_id = 1")):
        for r in substring.digest(ids).collect():
            assert r.n_removed == (0 if r.doc_id == 1 else 30)


def test_repeated_rows_cost_one_text(spark):
    """Thousands of rows alike in id and text are one text to the index."""
    text = " ".join(f"v{k}" for k in range(1500))
    docs = spark.createDataFrame([(7, text)] * 3000 + [(8, "head " + text), (6, "alone " * 3)], "doc_id bigint, text string").repartition(4)
    found = {r.id: sorted(zip(r.starts, r.ns)) for r in substring.repeats(docs).collect()}
    assert found.keys() == {8} and found[8][0][0] == 1 and sum(n for _, n in found[8]) == 1481
    rows = substring.digest(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, rows)) == [(6, 3, 0, 1), (7, 1500, 0, 3000), (8, 1501, 1500, 1)]
