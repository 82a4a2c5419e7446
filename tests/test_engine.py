"""Boundary cases of the column functions and operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimlake import catalog_docs
from claimlake.functions import intervals, limits, text, vectors
from claimlake.operators import acl, anchor, audit, chunk, dedup, nominate, quota, recall, retrieval, scd
from claimlake.sources import docs, tree

T = [datetime(2024, 1, d) for d in range(1, 6)]


def now():
    return F.lit("2024-01-20").cast("timestamp")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def at(k):
    return F.lit(T[k]) if k is not None else F.lit(None).cast("timestamp")


@pytest.mark.parametrize("a,z,t,want", [(1, 2, 1, True), (1, 2, 2, False), (1, None, 3, True), (1, None, 0, False)])
def test_contains(spark, a, z, t, want):
    assert value(spark, intervals.iv_contains(at(a), at(z), at(t))) is want


@pytest.mark.parametrize("x,y,want", [((0, 1), (1, 2), False), ((0, 2), (1, 3), True), ((0, None), (2, 3), True)])
def test_overlaps(spark, x, y, want):
    for p, q in ((x, y), (y, x)):
        assert value(spark, intervals.iv_overlaps(at(p[0]), at(p[1]), at(q[0]), at(q[1]))) is want
    assert value(spark, intervals.iv_meets(at(1), at(1))) is True


def test_close_never_clamps(spark):
    assert value(spark, intervals.iv_close(at(1), at(None), at(2))).until == T[2]
    assert value(spark, intervals.iv_close(at(1), at(None), at(1))).error
    assert value(spark, intervals.iv_close(at(1), at(2), at(3))).error


@pytest.mark.parametrize("used,ceiling,allowed,left", [(0, 3, True, 3), (2, 3, True, 1), (3, 3, False, 0), (4, 3, False, 0), (9, 0, True, -1), (9, -1, True, -1)])
def test_at_most(spark, used, ceiling, allowed, left):
    d = value(spark, limits.at_most(F.lit(used), ceiling, "r"))
    assert (d.allowed, d.remaining) == (allowed, left)


@pytest.mark.parametrize("calls,tokens,allowed", [(9, 999, True), (10, 0, False), (0, 1000, False)])
def test_cost(spark, calls, tokens, allowed):
    cfg = limits.LimitConfig(max_inference_calls=10, max_input_tokens=1000)
    assert value(spark, limits.decide_cost(F.lit(calls), F.lit(tokens), cfg)).allowed is allowed


@pytest.mark.parametrize("ceiling,more,live,want", [(100, 0.5, 99, 0), (100, 0.5, 100, 0), (100, 0.5, 101, 2), (100, 0.5, 110, 15), (1, 10.0, 5, 5), (0, 0.5, 9, 0)])
def test_prune_target(spark, ceiling, more, live, want):
    cfg = limits.LimitConfig(scope_claim_ceiling=ceiling, prune_aggressiveness=more)
    assert value(spark, limits.prune_target(F.lit(live), cfg)) == want


def test_window_is_open_below(spark):
    hour = timedelta(hours=1)
    for t, want in (("2024-01-19 23:00:00", False), ("2024-01-19 23:00:01", True), ("2024-01-20 00:00:00", True), ("2024-01-20 00:00:01", False)):
        assert value(spark, limits.in_window(F.lit(t).cast("timestamp"), now(), hour)) is want


def test_statement_normal_form(spark):
    for a, b in (("The sky is blue", "the   sky is blue"), ("one\ntwo", " ONE  TWO ")):
        assert value(spark, text.statement_hash(F.lit(a)) == text.statement_hash(F.lit(b)))
    assert value(spark, text.hash_normalized(F.lit(" \n\t"))) == ""


SOURCE = "line one\nline two\nline three\n"


@pytest.mark.parametrize("quote,base,want", [("two\nline three", 1, (2, 3)), ("line one", 41, (41, 41)), ("line one", 0, (1, 1)), ("line four", 1, None), ("", 1, None)])
def test_locate(spark, quote, base, want):
    got = value(spark, text.locate_quote(F.lit(SOURCE), F.lit(quote), F.lit(base)))
    assert (got and (got.line_start, got.line_end)) == want


def test_neutralize_and_truncate(spark):
    m = recall.DATA_END
    assert m not in value(spark, text.neutralize(F.lit(f"x {m} y"), (m,)))
    assert len(value(spark, text.truncate(F.lit("é" * 301)))) == 300
    assert value(spark, text.chunk_statement(F.lit(""), F.lit("docs/a.b.md"), F.lit("# h\nOne. Two"))) == "a.b — One."
    assert value(spark, text.kind_for_path(F.lit("a/b.RS"))) == "code" and value(spark, text.kind_for_path(F.lit("b.md"))) == "document"
    assert value(spark, text.wordpiece_counter(frozenset({"un", "##able", "a"}))(F.lit("Unable a zz"))) == 6


def test_acl(spark):
    c = spark.createDataFrame([("c", p, None) for p in ("alice", "bob", "carol")] + [("none", "bob", None), ("late", "bob", T[0])], "claim_id string, principal_id string, expires_at timestamp")
    links = spark.createDataFrame([("c", "e1"), ("c", "e2"), ("late", "e1"), ("bare", "e1")], "claim_id string, evidence_id string")
    e = spark.createDataFrame([("e1", "alice", None), ("e1", "bob", None), ("e2", "bob", None), ("e2", "carol", None)], "evidence_id string, principal_id string, expires_at timestamp")
    ids = spark.createDataFrame([(x,) for x in ("c", "none", "late", "bare")], "claim_id string")
    assert [tuple(r) for r in acl.permitted(ids, links, c, e, now()).collect()] == [("c", "bob")]
    for ends, want in ((None, True), (T[2], True), (T[1], False), (T[0], False)):
        assert value(spark, acl.active(F.lit(ends).cast("timestamp"), at(1))) is want


def arms(spark, **lists):
    rows = [("q", a, x, k, float(k)) for a, xs in lists.items() for k, x in enumerate(xs, 1)]
    return spark.createDataFrame(rows, "query_id string, arm string, claim_id string, rank int, raw double")


def test_rrf(spark):
    fused = retrieval.fuse_rrf(arms(spark, dense=["z", "y", "x"], lexical=["x", "y", "z"])).orderBy("fused_rank").collect()
    assert [r.claim_id for r in fused] == ["x", "z", "y"]
    both = retrieval.fuse_rrf(arms(spark, dense=["both", "d"], lexical=["l", "both"])).orderBy("fused_rank").first()
    assert both.claim_id == "both" and abs(both.score - (1 / 61 + 1 / 62)) < 1e-15
    zero = spark.createDataFrame([("q", "dense", "a", 0, 0.0), ("q", "dense", "b", 1, 0.0)], "query_id string, arm string, claim_id string, rank int, raw double")
    assert [r.claim_id for r in retrieval.fuse_rrf(zero).collect()] == ["b"]
    share = retrieval.single_arm_share(retrieval.fuse_rrf(arms(spark, dense=["a", "b", "c", "d"])), 4).first()
    assert (share.arm, share.share) == ("dense", 1.0)
    none = retrieval.single_arm_share(retrieval.fuse_rrf(arms(spark, dense=["a", "b"], lexical=["a", "b"])), 2).first()
    assert (none.arm, none.share) == ("", 0.0)


def test_websearch(spark):
    ev = [("1", "red blue green"), ("2", "blue red"), ("3", "green apple"), ("4", "red apple")]
    rows = spark.createDataFrame([(c, "e" + c, t) for c, t in ev], "claim_id string, evidence_id string, text string")
    postings = retrieval.build_postings(rows)
    for asked, want in (('"red blue"', {"1"}), ("red -apple", {"1", "2"}), ("apple or blue", {"1", "2", "3", "4"}), ("green apple", {"3"}), ("((&|!", set()), ("-red", set())):
        q = spark.createDataFrame([(1, asked)], "query_id int, text string")
        assert {r.claim_id for r in retrieval.lexical_search(q, postings).collect()} == want, asked


def test_budget_takes_smaller_ones_later(spark):
    rows = [(1, x, k, t, 2, 10) for k, (x, t) in enumerate((("a", 5), ("b", 7), ("c", 4), ("d", 1)), 1)]
    hits = spark.createDataFrame(rows, "query_id int, claim_id string, fused_rank int, tokens bigint, limit int, budget bigint")
    assert {r.claim_id for r in recall.budget_pack(hits).filter("kept").collect()} == {"a", "c"}


def files(spark, *texts, ext="md"):
    return spark.createDataFrame([("r", f"d{k}.{ext}", t) for k, t in enumerate(texts)], "repo string, path string, text string")


def test_chunks(spark):
    fenced = "# Real heading\n```\n# not a heading\n```\ntail"
    long = "\n".join(f"l{k}" for k in range(1, 96))
    inside = "\n".join(["```"] + ["x"] * 50 + ["```", "end"])
    rows = chunk.chunk_documents(files(spark, fenced, long, " \n\n", inside, "# A\n\n# B\nb\n#\nc")).orderBy("path", "ordinal").collect()
    by = {}
    for r in rows:
        by.setdefault(r.path, []).append((r.ordinal, r.heading, r.line_start, r.line_end))
    assert by["d0.md"] == [(0, "Real heading", 1, 5)]
    assert by["d1.md"] == [(0, "", 1, 40), (1, "", 41, 80), (2, "", 81, 95)]
    assert "d2.md" not in by
    assert by["d3.md"] == [(0, "", 1, 52), (1, "", 53, 53)]
    assert by["d4.md"] == [(0, "A", 1, 2), (1, "B", 3, 4), (2, "B", 5, 6)]


DOC = "# Decisions\nintro\n## D-010\ntext\n### Reasoning\nwhy so\n## D-011\nother\n"


def test_heading_paths(spark):
    got = {r.symbol_path: (r.line_start, r.line_end) for r in chunk.heading_sections(files(spark, DOC)).collect()}
    assert got == {"Decisions": (1, 2), "Decisions > D-010": (3, 4), "Decisions > D-010 > Reasoning": (5, 6), "Decisions > D-011": (7, 8)}


def test_anchor_law(spark):
    spans = spark.createDataFrame([("r", "d0.md", 6, 6)], "repo string, path string, line_start int, line_end int")
    (a,) = anchor.compute_anchor(files(spark, DOC), spans).collect()
    assert a.symbol_path == "Decisions > D-010 > Reasoning" and a.node_hash and a.window_hash
    anchors = spark.createDataFrame([a])
    cases = {
        "valid": [DOC.replace("why so", "why\n   so"), DOC.replace("other", "changed"), "# New\nx\n" + DOC],
        "semantic-change": [DOC.replace("why so", "why not"), DOC.replace("### Reasoning\nwhy so\n", "")],
        "ambiguous": [DOC + DOC],
    }
    for want, texts in cases.items():
        for t in texts:
            assert anchor.resolve_anchor(anchors, files(spark, t)).first().verdict == want
    assert anchor.resolve_anchor(anchors, files(spark, DOC).filter("false")).first().verdict == "missing-file"
    bare = anchors.withColumn("symbol_path", F.lit(""))
    assert anchor.resolve_anchor(bare, files(spark, DOC)).first().verdict == "unanchored"


@pytest.mark.parametrize(
    "ext,code,want",
    [
        ("go", "package x\nfunc (e *Executor) writeOne() {\n}\nfunc plain() {}\ntype T struct {", ["Executor.writeOne", "plain", "T"]),
        ("ts", "export class Service {\n  async handle(x: int): void {\n    if (x) {\n    }\n  }\n}\nconst f = (a) => a", ["Service", "Service > handle", "f"]),
        ("py", "class Repo:\n    def fetch(self):\n        pass\nasync def top():\n", ["Repo", "Repo > fetch", "top"]),
        ("rs", "impl Config {\n    pub fn scaled(&self) {}\n}\npub(crate) struct S;", ["Config", "Config > scaled", "S"]),
        ("c", "#define N 3\nint add(int a, int b) {\nreturn foo(a) {\n", ["N", "add"]),
        ("css", ".card {\n  color: red;\n}", [".card"]),
        ("java", "public class A {\n    public int f(int x) {\n", ["A", "A > f"]),
        ("kt", "fun String.ext() {}\ndata class D(val x: Int)", ["String.ext", "D"]),
        ("html", "<div>", []),
        ("cs", "namespace A.B {\n    public sealed class C {\n        public int Size { get; set; }\n        public async Task<int> Run(int x) {\n            if (x > 0) {", ["A.B", "A.B > C", "A.B > C > Size", "A.B > C > Run"]),
        ("cpp", "template <typename T>\nclass Box : public Base {\n  void put(T x) {\nint Box::get() const {\nusing Id = int;\nfor (int i = 0; i < 3; i++) {", ["Box", "Box > put", "Box::get", "Id"]),
        ("js", "export default function* main(a, b) {\nconst g = async x => x\nlet n = f(x => 1)\nfoo(1) {\n  get size() {\n  while (a) {\nexport default class {", ["main", "g", "g > size"]),
        ("rb", "module M\n  class A::B < C\n    def self.make?(x)\n    end", ["M", "M > A::B", "M > A::B > self.make?"]),
        ("php", "namespace App\\Http;\nabstract class K {\n  public static function &make() {\n  const X = 1;", ["App\\Http", "K", "K > make", "K > X"]),
        ("swift", "public final class V {\n  class func make() {}\n  init() {}\n}\nextension Array {", ["V", "V > make", "Array"]),
        ("scala", "package a.b\ncase class P(x: Int)\nobject Q {\n  def f(x: Int) = 1\n  lazy val y = 2", ["a.b", "P", "Q", "Q > f", "Q > y"]),
        ("rs", "macro_rules! say {\nunsafe impl<T: Clone> Tr<T> for fmt::Box<T> {\npub const fn f() {}\nstatic mut N: u8 = 1;\nextern \"C\" fn g() {", ["say", "fmt::Box", "f", "N", "g"]),
        ("java", "package x.y;\n@Test public <T> Map<String, List<T>> all(int a, Foo<Bar> b) throws E {\nreturn new Foo() {\nint a = f(x);", ["x.y", "all"]),
        ("c", "typedef struct node {\nstruct node *make(int (*f)(int), char c) {\nelse if (x) {\nstatic inline int get(void) {", ["node", "make", "get"]),
        ("go", "var f = func(x int) {\nfunc (Stack[T]) Push(x T) {\ntype (\nfunc main() {", ["f", "Stack.Push", "main"]),
    ],
)
def test_code_paths(spark, ext, code, want):
    rows = anchor.code_sections(files(spark, code, ext=ext)).orderBy("line_start").collect()
    assert [r.symbol_path for r in rows] == want


def claims(spark, rows):
    schema = "id string, statement_sha256 string, scope_kind string, scope_value string, confidence double, valid_from timestamp, valid_until timestamp, recorded_at timestamp, superseded_at timestamp, superseded_by string, supersede_reason string"
    return spark.createDataFrame([(i, h, "path", "s", c, r, None, r, None, None, None) for i, h, c, r in rows], schema)


def test_dedup_twice(spark):
    c = claims(spark, [("c", "h", 0.5, T[3]), ("a", "h", 0.5, T[1]), ("b", "h", 0.5, T[2]), ("x", None, 0.5, T[1]), ("y", None, 0.5, T[1]), ("m", "t", 0.5, T[1]), ("k", "t", 0.5, T[1])])
    once = dedup.dedup_claims(c, now())
    assert {r.id: r.superseded_by for r in once.filter("superseded_at is not null").collect()} == {"b": "a", "c": "a", "m": "k"}
    assert sorted(map(str, dedup.dedup_claims(once, now() + F.expr("interval 1 day")).collect())) == sorted(map(str, once.collect()))


def test_prune_twice(spark):
    cfg = limits.LimitConfig(scope_claim_ceiling=3, prune_aggressiveness=0.5)
    c = claims(spark, [(f"i{k}", None, k / 10, T[1]) for k in range(5)])
    once = scd.prune_scopes(c, cfg, now())
    assert {r.id for r in once.filter("supersede_reason = 'pruned'").collect()} == {"i0", "i1", "i2"}
    assert sorted(map(str, scd.prune_scopes(once, cfg, now()).collect())) == sorted(map(str, once.collect()))


def test_seed_merge_is_idempotent(spark):
    schema = "repo string, path string, ordinal int, content_sha256 string, statement string"
    new = spark.createDataFrame([("r", "p", 0, "a", "s"), ("r", "p", 1, "b", "s")], schema)
    live = spark.createDataFrame([], schema + ", id string")
    first = scd.seed_merge(live, new, now())
    assert scd.seed_report(first).first().asDict() == {"files": 1, "chunks": 2, "inserted": 2, "superseded": 0, "unchanged": 0}
    again = scd.seed_merge(first.select(*live.columns), new, now())
    assert {r.action for r in again.collect()} == {"unchanged"}
    changed = scd.seed_merge(first.select(*live.columns), new.withColumn("content_sha256", F.concat("content_sha256", "ordinal")).filter("ordinal = 1"), now())
    assert sorted(r.action for r in changed.collect()) == ["inserted", "superseded", "vanished"]


def test_candidate_gate(spark):
    good = ("j", "Decision", "s", "q", 0.5)
    bad = [("j", "Rumour", "s", "q", 0.5), ("j", "Decision", " ", "q", 0.5), ("j", "Decision", "s", "", 0.5), ("j", "Decision", "s", "q", 1.7), ("j", "Decision", "s", "q", -0.1), ("j", "Decision", "s" * 301, "q", 0.5), ("j", None, None, None, None)]
    rows = spark.createDataFrame([good, *bad], "job_id string, kind string, statement string, quote string, confidence double")
    assert nominate.valid_candidates(rows).count() == 1


def test_admission_does_not_count_denials(spark):
    cfg = limits.LimitConfig(contribution_quota=2, contribution_window=timedelta(microseconds=10), max_inference_calls=0, max_input_tokens=0)
    rows = [(k, "p", datetime(2024, 1, 1) + timedelta(microseconds=t), 0, 0) for k, t in enumerate((1, 2, 3, 4, 11, 12, 13))]
    rows += [(9, "", datetime(2024, 1, 1), 0, 0), (10, None, datetime(2024, 1, 1), 0, 0)]
    out = quota.replay_admission(spark.createDataFrame(rows, "event_id int, principal_id string, ts timestamp, calls int, tokens int"), cfg)
    got = {r.event_id: r.denied_reason is None for r in out.collect()}
    assert [got[k] for k in range(7)] == [True, True, False, False, True, True, False] and got[9] and got[10]


def test_audit_vectors(spark):
    v = spark.createDataFrame([(1, "a", [1.0] * 384), (1, "b", [1.0] + [0.0] * 383)], "embedding_model_id int, claim_id string, embedding array<float>")
    assert [(r.rule, r.key) for r in audit.audit_constraints({"claim_embeddings": v}).collect()] == [("unit length", "a/1")]
    assert value(spark, vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_read_repo_docs(spark, tmp_path):
    wanted = {"README.md", "AGENTS.md", ".cursorrules", "docs/a.md", "docs/sub/B.MD", "docs/.own.md"}
    for name in [*wanted, "notes.txt", "main.go", "docs/.hidden/x.md", "docs/c.txt"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text of " + name)
    (tmp_path / "docs/big.md").write_text("x" * (docs.MAX_BYTES + 1))
    rows = docs.read_repo_docs(spark, str(tmp_path), "r").collect()
    assert {r.path: r.text for r in rows} == {n: "text of " + n for n in wanted}


def test_repo_docs_trees(spark, tmp_path, monkeypatch):
    """Trees written and read again, by many tasks where one folder has many files."""
    texts = ["", None, "a\r\n\u2028b", "é" * 70_000, "\x00\ufeffz"]
    rows = [(f"r{k % 3}", f"docs/{'big' if k % 4 else f'd{k}'}/f{k}.md", texts[k % 5]) for k in range(200)]
    root = str(tmp_path / "trees")
    for _ in range(2):  # a second run changes nothing
        docs.write_repo_docs(spark.createDataFrame(rows, "repo string, path string, text string"), root)
    monkeypatch.setattr(tree, "TASK_BYTES", 1 << 20)
    assert len(tree.TreeReader(root, None, tree.MAX_BYTES).partitions()) > 3
    got = docs.read_repo_docs(spark, root)
    assert sorted(map(tuple, got.collect())) == sorted((r, p, t or "") for r, p, t in rows)
    assert docs.read_repo_docs(spark, root, max_bytes=100).count() == 160
    (tmp_path / "trees/r0/docs/d0/f0.md").write_bytes(b"a\xffb")
    assert "a\ufffdb" in {r.text for r in docs.read_repo_docs(spark, f"{root}/r0", "x").collect()}
    (tmp_path / "none").mkdir()
    assert docs.read_repo_docs(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no place below the root"):
        docs.write_repo_docs(spark.createDataFrame([("r", "../x", "t")], "repo string, path string, text string"), root)


def test_topk_plan_limits_before_the_shuffle(spark):
    hits = spark.range(1000).select((F.col("id") % 3).alias("query_id"), F.col("id").cast("string").alias("claim_id"), F.rand(1).alias("raw"))
    plan = retrieval.rank_hits(hits, [F.col("raw"), F.col("claim_id")], k=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_code_sections_take_whole_texts(spark, tmp_path):
    text = " ".join("a" * (i + 1) for i in range(200))
    spark.createDataFrame([(1, text, "s")], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog_docs.code_sections(spark, str(tmp_path)).orderBy("line_start").collect()
    assert [r.line_start for r in rows] == [i + 1 for i in range(200) if i % 4 < 2] and rows[-1].line_end == 200


def test_long_lines_are_looked_at(spark):
    code = "x = 1; " * 100_000 + "\n" + " " * 9 + "def " + "n" * 9000 + "(self):"
    (row,) = anchor.code_sections(files(spark, code, ext="py")).collect()
    assert row.title == "n" * 9000 and row.level == 9


def test_equal_lines_are_looked_at_once(spark):
    """No expression of Spark goes over the lines, and a line that is there again costs a look."""
    code = "\n".join(["class Same:", "    def one(self):", "        return 1"] * 2000)
    found = anchor.code_sections(files(spark, code, ext="py"))
    assert "transform" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.symbol_path for r in found.collect()} == {"Same", "Same > one"} and found.count() == 4000
    anchor._known_mark.cache_clear()
    assert len(anchor.code_marks("py", code.split("\n"))) == 4000 and anchor._known_mark.cache_info().misses == 3


@pytest.mark.parametrize(
    "lang,line,want",
    [
        ("py", "def f(x): # class g", "f"), ("py", "class A:\"\":B", "A::B"), ("py", "class class", "class"), ("ruby", "def get?", "get?"), ("rust", "impl A for B {", "B"), ("rust", "impl for", None),
        ("csharp", "union const {init\u00b2 x", "const"), ("csharp", "union const {initx", None), ("go", "var f = func\u00b2", "f"), ("py", "def \u00b2f():", None), ("py", "def \u00e9t\u00e9\u00b2(self)", "\u00e9t\u00e9\u00b2"),
        ("go", "func (r *T[\u2028]) f() {", "f"), ("css", ".a {", ".a"), ("css", "a:b; {", None), ("html", "class A", None), ("c", "#  define N", "N"), ("jsts", "\tf() {", "f"),
    ],
)
def test_definitions_in_odd_lines(lang, line, want):
    """As the expression over Spark's columns had them."""
    assert [m[2] for m in anchor.code_marks(lang, [line])] == ([want] if want else [])


def test_spans_of_one_file(spark):
    spans = spark.createDataFrame([("r", "d0.md", k, k) for k in range(0, 9)] + [("r", "gone.md", 1, 1)], "repo string, path string, line_start int, line_end int")
    got = {r.line_start: r.symbol_path for r in anchor.compute_anchor(files(spark, "before\n" + DOC), spans).collect()}
    want = ["", "", "Decisions", "Decisions", "Decisions > D-010", "Decisions > D-010", "Decisions > D-010 > Reasoning", "Decisions > D-010 > Reasoning", "Decisions > D-011"]
    assert [got[k] for k in range(9)] == want


def test_an_anchor_goes_through_its_text_once(spark, tmp_path):
    """One scan of the files, whatever is asked of them; and no text leaves a task where only the section is asked for."""
    files(spark, DOC).write.parquet(f"{tmp_path}/f")
    spans = spark.createDataFrame([("r", "d0.md", 6, 6)], "repo string, path string, line_start int, line_end int")
    of = spark.read.parquet(f"{tmp_path}/f")
    for make in (anchor.compute_anchor, anchor.place_spans):
        plan = make(of, spans)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(" parquet") == 1 and plan.count("MapInArrow") == 1
    whole = anchor.compute_anchor(of, spans).select("symbol_path", "node_hash").collect()
    assert anchor.place_spans(of, spans).select("symbol_path", "node_hash").collect() == whole != []


def test_no_text_is_moved_to_place_spans(spark):
    """Files are cut up below the join with the spans; in batches of any size, the rows are those of ``compute_anchor``, which moves the texts."""
    d = files(spark, DOC, "before\n" + DOC, "", None, "no heading", "```\n# no\n```\n#  two  spaces\n\n x \n").unionByName(files(spark, "class A:\n    def f(self):\n        pass\n", ext="py"))
    lines = [None, -3, 0, 1, 2, 4, 5, 9, 2**31 - 1]
    rows = [("r", p, k, k, n) for n, p in enumerate(["d5.md", "d1.md", "d4.md", "d0.md", "d2.md", "d3.md", "d0.py", "gone.md"]) for k in lines]
    spans = spark.createDataFrame(rows, "repo string, path string, line_start int, line_end int, n int")
    plan = anchor.place_spans(d, spans)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("MapInArrow")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(map(str, anchor.compute_anchor(d, spans).drop("window_hash", "byte_hash").collect()))
    try:
        for n in (1, 3, before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert sorted(map(str, anchor.place_spans(d, spans).collect())) == want and len(want) == 7 * len(lines)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_normal_form_in_tasks(spark):
    """Every character that a column function takes for white space, and no other; also beside those that only Python does."""
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + ["\ufeff", "\U0001f600", "\x1c"]
    texts = [f"{c}a{c} {c}b{c}" for c in chars] + [f"{c}\x1c {c}" for c in chars] + ["", " \n "]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.hash_normalized(F.col("t")).alias("h")).orderBy("k")
    assert [r.h for r in rows.collect()] == [text.normalizer(t)(t) for t in texts]


def test_odd_spans_and_lines(spark):
    doc = "#\u00a0A \n\x1cx\u2003y\r\n ``` \n# no\n```\n##\n"
    spans = spark.createDataFrame([("r", "d0.md", a, z) for a, z in [(-5, -4), (0, 1), (2, 2), (4, 3), (6, 99), (50, 60), (None, None)]] + [("r", "d1.md", 1, 1)], "repo string, path string, line_start int, line_end int")
    got = {(r.path, r.line_start): r for r in anchor.compute_anchor(files(spark, doc, None), spans).collect()}
    lines = doc.split("\n")[:-1]
    norm = lambda *x: value(spark, text.hash_normalized(F.lit("\n".join(x))))
    exact = lambda *x: value(spark, F.sha2(F.lit("\n".join(x)), 256))
    first, second = ("\u00a0A", norm(*lines[:5])), ("\u00a0A > ", norm("##"))
    want = {
        ("d0.md", -5): ("", "", "", exact()), ("d0.md", 0): ("", "", norm(*lines[:4]), exact(lines[0])), ("d0.md", 2): (*first, norm(*lines[:5]), exact(lines[1])),
        ("d0.md", 4): (*first, norm(*lines), exact()), ("d0.md", 6): (*second, norm(*lines[2:]), exact(lines[5])), ("d0.md", 50): (*second, "", exact()),
        ("d0.md", None): ("", "", norm(*lines), exact(*lines)), ("d1.md", 1): ("", "", "", exact()),
    }
    assert {k: tuple(r)[4:] for k, r in got.items()} == want


def test_dense_blocks_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    v = [[float(rng.randint(-3, 3)) for _ in range(4)] for _ in range(90)]
    vectors_df = spark.createDataFrame([(f"c{k:02}", x) for k, x in enumerate(v)], "claim_id string, embedding array<float>")
    asked = spark.createDataFrame([(k, v[k]) for k in range(20)], "query_id int, vec array<float>")
    want = {k: [c for _, c in sorted((-sum(a * b for a, b in zip(v[k], x)), f"c{n:02}") for n, x in enumerate(v))[:7]] for k in range(20)}
    for found in (retrieval.dense_search(asked, vectors_df, 7), retrieval.dense_search_blocks(asked, vectors_df, 7, block=6)):
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, {})[r.rank] = r.claim_id
        assert {k: [x[n] for n in sorted(x)] for k, x in got.items()} == want
    assert retrieval.dense_search_blocks(asked.limit(0), vectors_df).count() == 0


def test_known_at_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, T[k % 4], T[4] if k % 2 else None, T[k % 3], None) for k in range(12)], "id int, valid_from timestamp, valid_until timestamp, recorded_at timestamp, superseded_at timestamp")
    probes = spark.createDataFrame([(k, T[k], T[k]) for k in range(5)], "probe_id int, valid_at timestamp, known_at timestamp")
    once = sorted((r.probe_id, r.id) for r in dedup.known_at(rows, probes).collect())
    monkeypatch.setattr(dedup, "PROBES", 2)
    assert sorted((r.probe_id, r.id) for r in dedup.known_at(rows, probes).collect()) == once != []


def test_prune_equals_ranking(spark):
    import random

    rng = random.Random(6)
    rows = [(f"i{k:03}", None, rng.choice((0.5, 0.5, 0.25, 0.5004)), datetime(2024, 1, 1 + rng.randint(0, 1), rng.randint(0, 2), rng.randint(0, 3))) for k in range(200)]
    cfg = limits.LimitConfig(scope_claim_ceiling=100, prune_aggressiveness=0.3)
    got = {r.id for r in scd.prune_scopes(claims(spark, rows), cfg, now()).filter("supersede_reason = 'pruned'").collect()}
    assert got == {i for _, _, i in sorted((c, r, i) for i, _, c, r in rows)[:130]}


def test_admitted_events_of_before_count(spark):
    cfg = limits.LimitConfig(contribution_quota=2, contribution_window=timedelta(seconds=10), max_inference_calls=0, max_input_tokens=50, cost_window=timedelta(seconds=5))
    day = datetime(2024, 1, 1)
    at = lambda s: day + timedelta(seconds=s)
    schema = "event_id long, principal_id string, ts timestamp, calls int, tokens int"
    before = spark.createDataFrame([(None, "p", at(1), 1, 60), (None, "", at(1), 1, 60)], schema)
    events = spark.createDataFrame([(2**60 + 1, "p", at(2), 1, 1), (2**60 + 2, "p", at(7), 1, 1), (2**60 + 3, "p", at(8), 1, 1), (2**60 + 4, "p", at(12), 1, 1), (None, None, at(2), 1, 1)], schema)
    got = {r.event_id: r.denied_reason for r in quota.replay_admission(events, cfg, before).collect()}
    assert got == {2**60 + 1: "cost_ceiling", 2**60 + 2: None, 2**60 + 3: "contribution_quota", 2**60 + 4: None, None: None}


def test_chunks_of_a_document_stay_in_its_row(spark):
    """Nothing is shuffled, and a section of many fenced lines takes one pass."""
    lines = ["#", "intro", "# One ", *[f"a{k}" for k in range(85)], "```", "# no heading", *["x"] * 60, " ```", "tail", "##", "  ", "after"]
    files = spark.createDataFrame([("r", "p.md", "\n".join(lines)), ("r", "empty.md", ""), ("r", "none.md", None), ("r", "blank.md", "\n \n")], "repo string, path string, text string")
    out = chunk.chunk_documents(files)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = [(r.path, r.ordinal, r.heading, r.line_start, r.line_end) for r in out.orderBy("path", "ordinal").collect()]
    assert got == [("p.md", 0, "", 1, 2), ("p.md", 1, "One", 3, 42), ("p.md", 2, "One", 43, 82), ("p.md", 3, "One", 83, 151), ("p.md", 4, "One", 152, 152), ("p.md", 5, "One", 153, 155)]


def test_postings_of_requested_words_only(spark):
    """Other words' postings are neither kept nor moved, and lengths still count them."""
    rows = [(str(k), f"{k}-a", t) for k, t in enumerate(["red fox", "the red red barn of a fox", "blue sea", "the of", "", None, "red sea fox barn"])]
    texts = spark.createDataFrame(rows, "claim_id string, evidence_id string, text string")
    asked = spark.createDataFrame([(1, "red"), (2, '"red fox" or sea'), (3, "fox -barn"), (4, "absent")], "query_id bigint, text string")
    some = retrieval.build_postings(texts, retrieval.websearch_terms(asked).select("term").distinct())
    assert {r.term for r in some.collect()} == {"red", "fox", "sea", "barn"}
    found = retrieval.lexical_search(asked, some, lengths=retrieval.text_lengths(texts))
    assert sorted(map(str, found.collect())) == sorted(map(str, retrieval.lexical_search(asked, retrieval.build_postings(texts)).collect())) != []
    assert retrieval.text_lengths(texts).count() == 4
    only = retrieval.build_postings(texts.filter("claim_id = '1'"), asked.select(F.lit("barn").alias("term")).distinct())
    assert [(r.term, r.tf) for r in only.collect()] == [("barn", 1)]
