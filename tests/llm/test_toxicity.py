from claimlake.llm import toxicity


def test_held_out(spark):
    """Texts that bear the marks of the sample's toxic texts are caught, others are not."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    bad, good = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert len(bad) > 80
    assert sum(r.predicted for r in bad) / len(bad) > 0.85
    assert sum(r.predicted for r in good) / len(good) < 0.07


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        rows = toxicity.classify(odd_docs, marks).collect()
        assert len(rows) == odd_docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
        lowest = min(r.score for r in rows)
        assert all(r.score == lowest for r in rows if r.doc_id in (1, 2, 3))
    assert toxicity.classify(no_docs, labels).count() == 0


def test_lengths_tell_dictionaries_apart():
    toxic = [f"calm words stay here {k} you grubbish person {k % 7}x" for k in range(30)]
    ordinary = [f"calm words stay here and there person {k}" for k in range(60)]
    toxic = [t.replace("here", f"h{chr(97 + k % 26)}re grubbish") for k, t in enumerate(toxic)]
    model = toxicity.train(toxic, ordinary)
    assert "grub" in model.toxic and "calm" in model.ordinary
    hits = toxicity.Hits(model)
    assert hits.count("a calm person") == 0 and hits.count("such grubbish") == 1
    assert hits.count("Grubber " * 1000) == 1000


def test_clean_text_hides_nothing(spark):
    """A caught text stays caught, with no lower a score, whatever clean text stands before or after it."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(*toxicity.sample(docs, labels, ~toxicity.held_out(docs.doc_id)))
    rows = docs.join(labels, "doc_id").filter("text is not null").select("toxic", "text").collect()
    hits = toxicity.Hits(model)
    clean = " ".join(r.text for r in rows if r.toxic == 0 and hits.count(r.text) == 0)[:20_000]
    caught = [r.text for r in rows if r.toxic == 1 and hits.count(r.text)][:60]
    assert len(caught) == 60
    for text in caught:
        assert min(toxicity.level(hits.of(t)) for t in (f"{text} {clean}", f"{clean} {text}", f"{clean} {text} {clean}")) >= toxicity.level(hits.of(text))


def test_level_equals_all_stretches():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 1, 499, 500, 501, 2300):
        hits = (rng.random(n) < 0.004).astype(int)
        each = [hits[i : i + toxicity.UNIT].sum() for i in range(max(1, n - toxicity.UNIT + 1))]
        assert toxicity.level(hits) == min(toxicity.MOST, max(each))
