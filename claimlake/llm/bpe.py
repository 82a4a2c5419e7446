"""Byte-level BPE by a hierarchical-bitmap rank queue.

Each merge rank owns a bucket of positions in the pre-token's linked list of
symbols. Two levels of bitmaps say which buckets have entries, so find-first-set
on the summary and then on one word gives the least rank. Entries whose pair has
changed since are stale and skipped. A pre-token of n bytes takes O(n log n), so
very long pre-tokens (no white space for megabytes) are no special case.

Defined results: null and empty texts have no ids and the digest of no bytes;
lone surrogates cannot occur in Spark strings; repeated rows are encoded alike;
extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from operator import itemgetter

from pyspark.sql import DataFrame

from .common import kept_tool, per_batch, per_row

#: Pieces remembered by a Python worker, at most; on overflow the memory starts anew.
CACHE_PIECES = 200_000
#: Pre-tokens remembered in each of two generations; the older one goes on overflow.
CACHE_TOKENS = 400_000
#: Longer pieces are encoded without being remembered.
CACHE_CHARS = 48
_WORD = 8


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merger:
    """Encodes pre-tokens, many through one queue.

    Pre-tokens don't touch each other, so the least rank of all of them is also the
    next one of each that has it, and one find-first-set serves a whole bucket.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.ranks = ranks
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.first = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64).ravel()
        self.words = [0] * ((max(ranks.values(), default=0) >> _WORD) + 1)

    def __call__(self, piece: bytes) -> list[int]:
        return self.many([piece])[0]

    def many(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; the bitmaps are empty again afterwards."""
        import numpy as np

        get, words, summary = self.ranks.get, self.words, 0
        known = [get(x) for x in pieces]
        parts = [x for x, r in zip(pieces, known, strict=True) if r is None]
        buf = b"".join(parts)
        n = len(buf)
        edge, at = bytearray(n + 1), 0
        for x in parts:
            edge[at] = 1
            at += len(x)
        edge[n] = 1
        token = [self.single[b] for b in buf]
        end, before, pair, buckets = list(range(1, n + 1)), list(range(-1, n)), [-1] * n, {}
        if n > 1:
            raw = np.frombuffer(buf, np.uint8).astype(np.int64)
            r0 = self.first[raw[:-1] * 256 + raw[1:]]
            r0[np.frombuffer(edge, np.uint8)[1:n] == 1] = -1
            pair[: n - 1] = r0.tolist()
            order = np.argsort(r0, kind="stable")
            order = order[np.searchsorted(r0[order], 0) :]
            ranks, starts = np.unique(r0[order], return_index=True)
            for r, bucket in zip(ranks.tolist(), np.split(order, starts[1:]) if len(order) else (), strict=True):
                buckets[r] = bucket.tolist()
                words[r >> _WORD] |= 1 << (r & 255)
                summary |= 1 << (r >> _WORD)
        while summary:
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            r = (w << _WORD) + (bits & -bits).bit_length() - 1
            words[w] = bits = bits & (bits - 1)
            if not bits:
                summary &= summary - 1
            bucket = buckets.pop(r)
            bucket.sort()  # of overlapping pairs the leftmost merges
            for i in bucket:
                if pair[i] != r:
                    continue  # stale: this pair has changed since
                j = end[i]
                k = end[i] = end[j]
                token[i] = r
                pair[j] = -1
                if edge[k]:
                    pair[i] = -1
                else:
                    before[k] = i
                    x = get(buf[i : end[k]])
                    if x is None:
                        pair[i] = -1
                    else:
                        pair[i] = x
                        if x in buckets:
                            buckets[x].append(i)
                        else:
                            buckets[x] = [i]
                            words[x >> _WORD] |= 1 << (x & 255)
                            summary |= 1 << (x >> _WORD)
                if not edge[i]:
                    p = before[i]
                    x = get(buf[p:k])
                    if x is None:
                        pair[p] = -1
                    else:
                        pair[p] = x
                        if x in buckets:
                            buckets[x].append(p)
                        else:
                            buckets[x] = [p]
                            words[x >> _WORD] |= 1 << (x & 255)
                            summary |= 1 << (x >> _WORD)
        out, i = [], 0
        for x, r in zip(pieces, known, strict=True):
            if r is not None:
                out.append([r])
                continue
            stop, ids = i + len(x), []
            while i < stop:
                ids.append(token[i])
                i = end[i]
            out.append(ids)
        return out


class _Irregular(Exception):
    """White space meets the space at which a text was cut."""


class Encoder(dict):
    """Text to ids, as little-endian unsigned 32-bit integers.

    A single space between two other characters always opens a pre-token, so the
    text is cut there and the pieces are looked up; the dictionary holds, for a
    piece, the ids of the space and the piece. Pieces that it lacks are split into
    pre-tokens, which have a larger memory of their own.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.merge = Merger(ranks)
        # the encoder that is matched takes \s as the White_Space property, which lacks \x1c to \x1f
        pattern = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.find = regex.compile(pattern).findall
        self.cuts = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
        self.space = regex.compile(r"\p{White_Space}").match
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def token(self, token: str) -> bytes:
        """Ids of one pre-token."""
        ids = self.old.get(token)
        if ids is None:
            found = self.merge(token.encode("utf-8"))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(token) <= CACHE_CHARS:
            if len(self.young) >= CACHE_TOKENS:
                self.young, self.old = {}, self.young
            self.young[token] = ids
        return ids

    def learn(self, texts: list[str]) -> None:
        """Merge together all pre-tokens of these texts that are not remembered."""
        pieces: set[str] = set()
        for text in texts:
            pieces.update(text.split(" "))
        need: set[str] = set()
        for piece in pieces:
            if piece in self:
                continue
            if piece.isalpha():
                need.add(" " + piece)
            elif piece:
                need.update(self.find(" " + piece))
        todo = [x for x in need if x not in self.young and x not in self.old and len(x) <= CACHE_CHARS]
        if len(self.young) + len(todo) > CACHE_TOKENS:
            self.young, self.old = {}, self.young
        for k in range(0, len(todo), 20_000):
            part = todo[k : k + 20_000]
            for x, ids in zip(part, self.merge.many([x.encode("utf-8") for x in part]), strict=True):
                self.young[x] = struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        return b"".join([self.young.get(x) or self.token(x) for x in self.find(text)])

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            piece_ids = self.young.get(" " + piece) or self.token(" " + piece)
        elif not piece or self.space(piece[0]) or self.space(piece[-1]):
            raise _Irregular
        else:
            piece_ids = self.ids(" " + piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = piece_ids
        return piece_ids

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            if rest and (not first or self.space(first[-1])):
                raise _Irregular
            return self.ids(first) + b"".join(map(self.__getitem__, rest))
        except _Irregular:
            first, *rest = self.cuts.split(text)
            out = [self.ids(first)]
            for piece in rest:
                try:
                    out.append(self[piece])
                except _Irregular:
                    out.append(self.ids(" " + piece))
            return b"".join(out)


class Decoder:
    """Ids back to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    def decode(self, ids: bytes) -> bytes:
        found = memoryview(ids).cast("I").tolist()
        return b"".join(itemgetter(*found)(self.table)) if len(found) > 1 else b"".join(self.table[i] for i in found)


def tools(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """The encoder and decoder of a Python worker, made once."""

    def make():
        ranks = read_ranks(path)
        return Encoder(ranks, pattern), Decoder(ranks)

    return kept_tool(("bpe", path, pattern), make)


def encode_texts(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (array of long) per row; a null text counts as empty."""

    def make():
        encoder, _ = tools(path, pattern)

        def many(keys, texts):
            texts = [t or "" for t in texts]
            encoder.learn(texts)
            return keys, [memoryview(encoder.encode(t)).cast("I").tolist() for t in texts]

        return many

    return per_batch(docs, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<bigint>", make, [key, text])


def decode_ids(df: DataFrame, path: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``bytes`` (binary) per row; null ids decode to no bytes."""

    def make():
        decoder = Decoder(read_ranks(path))
        return lambda k, x: (k, decoder.decode(struct.pack(f"<{len(x or ())}I", *(x or ()))))

    return per_row(df, f"{key} {df.schema[key].dataType.simpleString()}, bytes binary", make, [key, ids])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode each whole text, decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def make():
        encoder, decoder = tools(path, pattern)
        sha = hashlib.sha256

        def many(doc_ids, texts):
            texts = [t or "" for t in texts]
            encoder.learn(texts)
            out = []
            for text in texts:
                ids = encoder.encode(text)
                out.append((len(ids) // 4, sha(ids).hexdigest(), sha(decoder.decode(ids)).hexdigest()))
            return doc_ids, *(zip(*out, strict=True) if out else ((), (), ()))

        return many

    return per_batch(docs, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, ["doc_id", "text"])
