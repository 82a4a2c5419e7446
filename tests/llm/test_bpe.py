import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from claimlake.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_equals_library_on_random_text():
    rng, encoder = random.Random(1), bpe.Encoder(RANKS, P.PATTERN)
    for _ in range(3000):
        text = "".join(rng.choice("ab  \n\t'sd1²é\x85\x1c漢,.!") for _ in range(rng.randint(0, 25)))
        if rng.random() < 0.5:
            encoder.learn([text])
        assert memoryview(encoder.encode(text)).cast("I").tolist() == LIBRARY.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("text", ["aab" * 20_000, "a" * 5001, "ééé" * 999, "1" * 777, " " * 400 + "x", "\n\n\n a"])
def test_very_long_pretokens(text):
    ids = bpe.Encoder(RANKS, P.PATTERN).encode(text)
    assert memoryview(ids).cast("I").tolist() == LIBRARY.encode_ordinary(text)
    assert bpe.Decoder(RANKS).decode(ids) == text.encode()


def test_memories_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    monkeypatch.setattr(bpe, "CACHE_TOKENS", 5)
    encoder = bpe.Encoder(RANKS, P.PATTERN)
    for k in range(60):
        text = f"w{k % 9} some{k} text, again and\nagain {k}"
        encoder.learn([text])
        assert memoryview(encoder.encode(text)).cast("I").tolist() == LIBRARY.encode_ordinary(text)


def test_round_trip(odd_docs, no_docs, few_docs):
    path = P.path("byte_bpe_50k.tiktoken")
    for docs in (odd_docs, few_docs):
        got = sorted(map(repr, bpe.round_trip(docs, path, P.PATTERN).collect()))
        want = []
        for r in docs.collect():
            text = r.text or ""
            ids = LIBRARY.encode_ordinary(text)
            raw = b"".join(i.to_bytes(4, "little") for i in ids)
            want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
        assert got == sorted("Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, row)) + ")" for row in want)
    assert bpe.round_trip(no_docs, path, P.PATTERN).count() == 0


def test_general_interface(odd_docs):
    path = P.path("byte_bpe_50k.tiktoken")
    back = bpe.decode_ids(bpe.encode_texts(odd_docs, path, P.PATTERN), path)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((r.text or "").encode() for r in odd_docs.collect())
