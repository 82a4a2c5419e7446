import random
from collections import Counter

from claimlake.llm import quality


def brute(text):
    text = text or ""
    w = text.encode().split()
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = set()
    for i in range(len(w) - 4):
        if runs[tuple(w[i : i + 5])] > 1:
            again |= set(range(i, i + 5))
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    return (
        len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(lines),
        sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text), text.count("!"), sum(a == b for a, b in zip(w, w[1:])),
    )


def test_measures(odd_docs, no_docs):
    rows = quality.ledger(odd_docs).collect()
    want = Counter((r.doc_id, *brute(r.text)) for r in odd_docs.collect())
    assert Counter((r.doc_id, *(r[m] for m in quality.MEASURES)) for r in rows) == want
    assert quality.ledger(no_docs).count() == 0


def test_runs_of_many_words():
    rng = random.Random(1)
    text = " ".join(str(rng.randint(0, 9000)) for _ in range(30_000))
    text += " a b c d e f " + text[:400]
    assert quality.measure(text) == brute(text)


def test_policies_and_ablation(odd_docs):
    rows = quality.ledger(odd_docs)
    for version in quality.POLICIES:
        policy = quality.POLICIES[version]
        judged = quality.apply_policy(rows, policy).collect()
        names = [name for name, _ in quality.RULES]
        failing = [{n for k, n in enumerate(names) if r.fail_bits >> k & 1} & set(policy.rules) for r in judged]
        assert [r.kept for r in judged] == [not f and not r.base_failed for f, r in zip(failing, judged)]
        for a in quality.ablation(rows, policy).collect():
            assert a.failing == sum(a.rule in f for f in failing) and a.only == sum(f == {a.rule} for f in failing)
            assert a.rows == len(judged)
