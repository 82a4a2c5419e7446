import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
from tokenizers import Tokenizer

from claimlake.llm import packing

PATH = P.path("word_bpe_49k.json")


def check(rows, docs, seq_len):
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), seq_len)):
            part = np.array(ids[at : at + seq_len], "<u4").tobytes()
            want[d.doc_id, k, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= seq_len
    return len(sequences), sum(r.length for r in rows)


def test_pack_documents(odd_docs, no_docs, few_docs):
    for docs, seq_len in ((odd_docs, 64), (few_docs, 2048)):
        n, total = check(packing.pack_documents(docs, PATH, seq_len).collect(), docs.collect(), seq_len)
        assert n <= -(-total // seq_len) * 1.02 + 1
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_plan_uses_every_count_and_packs_tightly():
    rng = random.Random(3)
    for seq_len, top, n in ((128, 128, 4000), (2048, 2048, 20_000), (64, 5, 900), (100, 51, 300)):
        counts = Counter(rng.randint(1, top) for _ in range(n))
        counts[7 % top + 1] += n  # a hot length
        groups = packing.plan(counts, seq_len)
        used = Counter()
        for pattern, times in groups:
            assert sum(pattern) <= seq_len
            for length in pattern:
                used[length] += times
        assert used == counts
        if top <= seq_len // 2 or top == seq_len:
            assert sum(t for _, t in groups) <= sum(k * v for k, v in counts.items()) / seq_len * 1.01 + 1


def test_words_overflow(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    words, library = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    texts = ["The cat's  mat", "É́té 12 34", "x" * 200 + " tail", "", "the cat sat", "A! ÀB, dogs?!... Straße İx ΑΣ e\u0301t --", None, "Ünï漢字, don't. (a)b' Å \u212b \u00a0x"]
    for some in (texts, [*texts, "x\x1cy z"], [], [None], texts[::-1]):
        flat, edge = words(pa.array(some, pa.string()))
        got = [flat[a:z].tolist() for a, z in zip(edge, edge[1:], strict=False)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in some]


def test_fit_is_used():
    """Sequences follow fitted patterns; the residual is packed beside them."""
    counts = Counter({1500: 40, 548: 40, 1000: 30, 524: 60, 700: 5})
    groups = packing.plan(counts, 2048)
    assert sum(n for _, n in groups) == 73
    for fitted, rest in packing.fit(dict(counts), 2048):
        assert sum(n for _, n in fitted) >= 17 and all(sum(p) >= 2044 for p, _ in fitted)
        used = Counter(rest)
        for p, n in fitted:
            used.update({length: n * p.count(length) for length in set(p)})
        assert used == counts
    assert any(groups[: len(f)] == f and f for f, _ in packing.fit(dict(counts), 2048))


def test_blocks_cover_all_rows():
    texts = pa.array(["a" * 10, None, "b" * packing.BLOCK_BYTES, "", "c", "d" * (packing.BLOCK_BYTES - 1), "ee"])
    runs = list(packing._blocks(texts))
    assert [i for r in runs for i in range(r.start, r.stop)] == list(range(len(texts)))
    assert len(runs) == 4
