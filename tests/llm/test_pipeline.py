import corpus_pipeline
from claimlake.llm import pii, queries, substring
from test_packing import check
from test_simhash import brute_groups, brute_print


def test_stages_equal_brute_force(spark, few_docs):
    docs = few_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        before = docs.collect()
        if name != "best_fit_packing":
            assert out.schema == few_docs.schema
        if name == "language_id":
            want = {(r.doc_id, r.text) for r in before if r.text and any(map(str.isalpha, r.text))}
        elif name == "simhash_near_dedup":
            groups = brute_groups([(r.doc_id, brute_print(r.text)) for r in before])
            want = {(r.doc_id, r.text) for r in before if r.doc_id in set(groups.values())}
        elif name == "substring_dedup":
            want = cut(before)
            assert {(r.doc_id, tuple(r.text.encode().split())) for r in out.collect()} == want
            want = None
        elif name == "pii_surrogates":
            replacer = pii.Replacer(queries.PII_KEY.encode())
            want = {(r.doc_id, replacer(r.text)[0]) for r in before}
        else:
            check(out.collect(), before, 2048)
            want = None
        if want is not None:
            assert {(r.doc_id, r.text) for r in out.collect()} == want
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.ORACLE_SQL is None


def cut(rows):
    first, split = {}, [(r.doc_id, r.text.encode().split()) for r in rows]
    n = substring.WINDOW
    for d, w in split:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = set()
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (d, i):
                gone[i : i + n] = [True] * n
        out.add((d, tuple(x for x, g in zip(w, gone) if not g)))
    return out


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            docs = spark.createDataFrame(out.collect(), out.schema)
            if name != "best_fit_packing":
                assert docs.columns == odd_docs.columns
