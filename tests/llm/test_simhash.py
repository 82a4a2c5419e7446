import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from claimlake.llm import graph, simhash


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = text.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    found = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def brute_groups(pairs):
    """{(doc_id, fingerprint): component}, by comparing every two."""
    prints = sorted({f for _, f in pairs})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f): least.get(find(f)) for d, f in pairs}


def test_near_duplicates(odd_docs, no_docs, few_docs):
    for docs in (odd_docs, few_docs):
        pairs = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
        want = brute_groups(pairs)
        got = simhash.near_duplicates(docs).collect()
        assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(d), f"{f:016x}") for d, f in pairs)
        for r in got:
            assert want[r.doc_id, int(r.fingerprint, 16)] == r.component_id
        kept = simhash.keep_first(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == set(want.values())
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("cell", [30, 4096])
def test_links_of_dense_prints(spark, cell):
    """Chains and a dense ball; small cells take every level of the dealing."""
    rng = random.Random(4)
    centre, prints = rng.getrandbits(64), set()
    for _ in range(400):
        f = centre
        for _ in range(rng.randint(0, 2)):
            f ^= 1 << rng.randrange(64)
        prints.add(f)
    f = rng.getrandbits(64)
    for _ in range(60):
        prints.add(f)
        for _ in range(3):
            f ^= 1 << rng.randrange(64)
    prints |= {rng.getrandbits(64) for _ in range(300)}
    pairs = list(enumerate(sorted(prints)))
    want = brute_groups(pairs)
    rows = [(int(np.uint64(f).view(np.int64)), d) for d, f in pairs]
    first = spark.createDataFrame(rows, "fp bigint, first bigint")
    found = simhash.components(simhash.links(first, cell)).collect()
    root = {r.node: r.root for r in found}
    groups, wanted = {}, {}
    for f, d in rows:
        groups.setdefault(root.get(f, f), set()).add(d)
    for (d, _), c in want.items():
        wanted.setdefault(c, set()).add(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_links_of_the_last_level(spark):
    """More than CELL prints in the 15 free bits of one last cell; all other cells split the one link of ``a`` and ``b``."""
    a = 0x123456789ABC
    b = a ^ (1 << 49 | 1 << 54 | 1 << 59)
    prints = {a | x << 49 for x in np.random.default_rng(5).choice(1 << 15, 5000, replace=False).tolist()}
    prints = {f for f in prints if (f ^ a).bit_count() > 3} | {a, b}
    assert len(prints) > simhash.CELL
    rows = [(int(np.uint64(f).view(np.int64)),) for f in prints]
    root = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame(rows, "fp bigint"))).collect()}
    assert a in root and root[a] == root[int(np.uint64(b).view(np.int64))]


def test_components_without_an_end_are_an_error(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(64)], "u bigint, v bigint")
    with pytest.raises(ValueError, match="round 1"):
        graph.components(chain, rounds=1)
    assert {r.root for r in graph.components(chain).collect()} == {0}
