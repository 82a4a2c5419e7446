"""Repeated-passage removal with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words of one document. Words covered by a window
whose words also start earlier (smaller doc_id, or same document and earlier start)
are removed.

1. Winnowing picks anchors (hashed runs of ``GRAM`` words): the least in each window,
   so equal windows have equal anchors. Anchors of more than one text, or twice in
   one, are kept in a table. Windows with another anchor occur once.
2. Runs of windows with one kept anchor, as plain words, are dealt to shards by that
   anchor; equal runs become one on the way. Windows of very frequent anchors are
   dealt one by one by their own words, so that no anchor fills a shard.
3. Each shard builds an FM-index over its runs: a bounded suffix order, its
   Burrows-Wheeler transform in a wavelet matrix of bit vectors with rank counts, and
   backward search streams all windows through it. The matching statistic of a
   window is how many words the search took; a full window whose interval holds an
   earlier occurrence is reported.
4. Reported intervals meet the texts again.

Exact copies of a text need no search: all windows of all but the least doc_id repeat.

Defined results: null and empty texts have no words; a null doc_id counts as larger
than any; rows with one doc_id are one document at the same place, so neither of two
repeated rows removes the other; empty tables give none; extra columns are kept by
``keep_novel`` and ignored by ``digest``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, mix64, per_batch, release, words, written

WINDOW, GRAM = 20, 6
#: An anchor with more occurrences than this has its windows dealt one by one.
HOT = 2_000
#: Rows that share a doc_id, at most, before the texts' hashes tell them apart.
SHARED = 64
#: Bytes of run text that a shard is meant to hold; the number of shards follows.
SHARD_BYTES = 12_000_000
#: Distinct runs that a task keeps to merge equal ones before the shuffle.
HELD = 150_000

_LAST = (1 << 63) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_SHORT = _powers(256)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit polynomial hash of each word."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    own = np.nonzero(~_SPACE[raw])[0]
    if not len(own):
        return np.zeros(0, np.uint64)
    first = np.ones(len(own), bool)
    first[1:] = np.diff(own) > 1
    starts = np.nonzero(first)[0]
    sizes = np.diff(np.append(starts, len(own)))
    place = np.arange(len(own)) - np.repeat(starts, sizes)
    power = _SHORT if (longest := int(sizes.max())) <= len(_SHORT) else _powers(longest)
    return np.add.reduceat(_BYTE[raw[own]] * power[place], starts)


def anchors(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of all word runs of GRAM, the place of the least in each window, and the number of words."""
    h = word_hashes(text)
    n = len(h)
    if n < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams = grams * _BASE + h[k : n - GRAM + 1 + k]
    grams = mix64(grams)
    width = WINDOW - GRAM + 1  # runs in a window
    # sliding leftmost minimum by doubling: least of [i, i + size)
    place, size = np.arange(len(grams)), 1
    while size < width:
        step = min(size, width - size)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(grams[a] <= grams[b], a, b)
        size += step
    return grams, place, n


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def with_identity(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``_id`` (doc_id, null as the largest) and ``_th`` (hash of the text)."""
    return docs.withColumn("_id", F.coalesce(doc_id, F.lit(_LAST))).withColumn("_th", F.xxhash64(text))


def _anchor_rows(docs: DataFrame, places: bool) -> DataFrame:
    """Anchors of each document: with text hash and whether repeated in it, or (``places``) with document and place."""

    def make():
        def one(grams, place):
            picked = np.unique(place)
            return picked, grams[picked]

        def many(ids, hashes, texts):
            cols = ([], [], [])
            for i, th, text in zip(ids, hashes, texts, strict=True):
                grams, place, _ = anchors(text)
                if not len(place):
                    continue
                picked, found = one(grams, place)
                if places:
                    cols[0].append(found)
                    cols[1].append(np.full(len(found), i, np.int64))
                    cols[2].append(picked.astype(np.int32))
                else:
                    found, times = np.unique(found, return_counts=True)
                    cols[0].append(found)
                    cols[1].append(np.full(len(found), th, np.int64))
                    cols[2].append(times.astype(np.int32))
            if not cols[0]:
                return (), (), ()
            return _signed(np.concatenate(cols[0])), np.concatenate(cols[1]), np.concatenate(cols[2])

        return many

    schema = "anchor bigint, id bigint, place int" if places else "anchor bigint, th bigint, times int"
    return per_batch(docs, schema, make, ["_key", "_th", "text"], rows=256)


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """``anchor`` and ``n`` (its occurrences) of anchors found in two texts, or twice in one."""
    found = _anchor_rows(docs, False).groupBy("anchor")
    found = found.agg(F.min("th").alias("a"), F.max("th").alias("z"), F.max("times").alias("t"), F.sum("times").alias("n"))
    return found.filter("a != z or t > 1").select("anchor", "n")


class WaveletMatrix:
    """Rank queries over a sequence of symbols: a bit vector with block counts for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.words, self.counts, self.zeros = [], [], []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 + -len(bit) % 64, bool)]), bitorder="little").view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[: len(packed)].astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[k][block] + np.bitwise_count(self.words[k][block] & below)

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``lo`` and before ``hi``."""
        start = np.zeros(len(symbol), np.int64)
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            edges = [self._ones(k, x).astype(np.int64) for x in (start, lo, hi)]
            start, lo, hi = (np.where(one, self.zeros[k] + e, x - e) for x, e in zip((start, lo, hi), edges, strict=True))
        return lo - start, hi - start


class FMIndex:
    """Index of symbol sequences (symbols from 1; 0 stands after each), ordered by their first ``depth`` symbols.

    Equal contexts keep the order of the text, so the first entry of an interval is
    its earliest occurrence.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth = depth
        n, top = len(symbols), int(symbols.max(initial=0)) + 1
        rank, have = symbols.astype(np.int64), 1
        while have < depth:
            step = min(have, depth - have)
            # the order of `have` symbols at a place and of `have` symbols `step` further on
            shifted = np.zeros(n, np.int64)
            shifted[: max(0, n - step)] = rank[step:] + 1
            width = int(shifted.max(initial=0)) + 1
            rank = np.unique(rank * width + shifted, return_inverse=True)[1].reshape(-1)
            have += step
        self.order = np.argsort(rank, kind="stable")
        before = symbols[self.order - 1]
        if n:
            before[self.order == 0] = symbols[-1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top))]).astype(np.int64)
        self.tree = WaveletMatrix(before.astype(np.int64), max(1, (top - 1).bit_length()))
        self.symbols = symbols

    def match(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search from each place, over ``depth`` symbols of the text itself.

        Returns the matching statistic (symbols taken while the interval held more than
        one entry) and the first entry of the interval, or -1 below full depth.
        """
        n = len(self.symbols)
        took, first = np.zeros(len(ends), np.int64), np.full(len(ends), -1, np.int64)
        live, lo, hi = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), n, np.int64)
        for k in range(self.depth):
            c = self.symbols[ends[live] - k]
            a, z = self.tree.rank(c, lo, hi)
            lo, hi = self.first[c] + a, self.first[c] + z
            more = hi - lo > 1
            live, lo, hi = live[more], lo[more], hi[more]
            took[live] = k + 1
            if not len(live):
                break
        if len(live):
            first[live] = self.order[lo]
        return took, first


#: kind 0: a run (key, words, id, th, start); kind 1: windows start to start + n - 1 of a document are repeated.
_RUNS = "key bigint, run binary, id bigint, th bigint, start int, n int"
_ARROW = pa.schema([("key", pa.int64()), ("run", pa.binary()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types, strict=True)], schema=_ARROW)


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the places of their repeated anchors: the runs to be searched, equal ones of a task as one."""
    held: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    done: list[tuple] = []
    for b in batches:
        for i, th, text, places, hot in zip(*(c.to_pylist() for c in b.columns), strict=True):
            grams, place, n = anchors(text)
            own = words(text)
            if not len(place):
                continue
            state = np.zeros(len(grams), np.int8)
            at = np.array(places, np.int64)
            at, frequent = at[at < len(grams)], np.array(hot, bool)[np.array(places) < len(grams)]
            state[at] = 1 + frequent
            kind = state[place]
            alone = kind == 2
            cut = np.ones(len(place), bool)
            cut[1:] = (place[1:] != place[:-1]) | alone[1:] | alone[:-1]
            begin = np.nonzero(cut)[0]
            begin = begin[kind[begin] > 0]
            stop = np.append(np.nonzero(cut)[0], len(place))
            stop = stop[np.searchsorted(stop, begin, "right")]
            keys = _signed(grams[place[begin]]).tolist()
            for a, z, key, single in zip(begin.tolist(), stop.tolist(), keys, alone[begin].tolist(), strict=True):
                run = b" ".join(own[a : z + WINDOW - 1])
                if single:
                    key = int.from_bytes(hashlib.blake2b(run, digest_size=8).digest(), "little", signed=True)
                here, other = (i, a, th), held.get((key, run))
                if other is None:
                    held[key, run] = here
                    continue
                if here < other:
                    held[key, run], here, other = here, other, here
                if here[:2] != other[:2]:
                    done.append((hash(here) >> 1, None, here[0], here[2], here[1], z - a))
                else:  # the same place of one document, in repeated rows: judged by the shard
                    done.append((key, run, here[0], here[2], here[1], z - a))
        if len(held) > HELD or len(done) > HELD:
            yield from _flush(held, done)
    yield from _flush(held, done)


def _flush(held: dict, done: list) -> Iterator[pa.RecordBatch]:
    rows = [(key, run, i, th, a, len(run.split()) - WINDOW + 1) for (key, run), (i, a, th) in held.items()]
    for part in (done, rows):
        for k in range(0, len(part), 20_000):
            yield _table(part[k : k + 20_000])
    held.clear()
    done.clear()


def _search_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of a shard: the windows that also start earlier."""
    best: dict[bytes, tuple[int, int, int]] = {}
    done: list[tuple] = []
    for b in batches:
        for _, run, i, th, start, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if run is None:
                done.append((0, None, i, th, start, n))
                continue
            here, other = (i, start, th), best.get(run)
            if other is None:
                best[run] = here
                continue
            if here < other:
                best[run], here, other = here, other, here
            if here[:2] != other[:2]:
                done.append((0, None, here[0], here[2], here[1], n))
            else:  # repeated rows: whatever holds for the one that is searched holds for this one
                best.setdefault(b"\n" + run + b"\n%d" % here[2], here)
        if len(done) >= 20_000:
            yield _table(done)
            done = []
    yield _table(done)
    if not best:
        return
    runs = sorted(best.items(), key=lambda x: x[1])
    ids: dict[bytes, int] = {}
    flat, sizes = [], []
    for run, _ in runs:
        own = (run.split(b"\n")[1] if run[:1] == b"\n" else run).split(b" ")
        flat += [ids.setdefault(w, len(ids) + 1) for w in own]
        flat.append(0)
        sizes.append(len(own))
    symbols = np.array(flat, np.int64)
    del flat, ids
    size = np.array(sizes)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    windows = size - WINDOW + 1
    owner = np.repeat(np.arange(len(runs)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    index = FMIndex(symbols, WINDOW)
    place = begin[owner] + offset
    found = np.zeros(len(place), bool)
    doc = np.array([v[0] for _, v in runs], np.int64)
    at = np.array([v[1] for _, v in runs], np.int64)
    for k in range(0, len(place), 200_000):
        part = slice(k, k + 200_000)
        took, first = index.match(place[part] + WINDOW - 1)
        full = took == WINDOW
        run = np.searchsorted(begin, first, "right") - 1
        there = at[run] + first - begin[run]
        own = owner[part]
        found[part] = full & ((doc[run] < doc[own]) | (doc[run] == doc[own]) & (there < at[own] + offset[part]))
    hit = np.nonzero(found)[0]
    if not len(hit):
        return
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) > 1) | (owner[hit[1:]] != owner[hit[:-1]])
    lead = np.nonzero(new)[0]
    length = np.diff(np.append(lead, len(hit)))
    th = [v[2] for _, v in runs]
    rows = [(0, None, int(doc[o]), th[o], int(at[o] + offset[h]), int(n)) for h, n in zip(hit[lead], length, strict=True) for o in (owner[h],)]
    for k in range(0, len(rows), 20_000):
        yield _table(rows[k : k + 20_000])


def repeats(docs: DataFrame) -> DataFrame:
    """``id``, ``th``, ``starts``, ``ns`` of each text with repeated windows: n windows from each start on.

    A null in ``ns`` stands for all windows of a copy.
    """
    spark = docs.sparkSession
    docs = with_identity(docs.select("doc_id", "text")).filter("text is not null")
    # places meet their text by its id, or by a hash: of a text without an id, or of id and text where many share one
    ids = written(docs.groupBy("_id", "_th").agg(F.min(F.sha2("text", 256)).alias("sha"), F.count("*").alias("rows")))
    again = ids.filter("rows > 1").select("_id", "_th")
    if not again.isEmpty():  # rows alike in id and text count once from here on
        docs = docs.join(again, ["_id", "_th"], "left_anti").unionByName(written(docs.join(again, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"])))
    many = ids.filter(F.col("_id") != _LAST).groupBy("_id").count().filter(F.col("count") > SHARED)
    key = F.xxhash64("_id", "_th") if not many.limit(1).isEmpty() else F.when(F.col("_id") == _LAST, F.col("_th")).otherwise(F.col("_id"))
    first = written(ids.groupBy("sha").agg(F.min("_id").alias("rep"), F.count("*").alias("n")).filter("n > 1"))
    copies = written(join_hot(ids, first, ["sha"], "n").filter("_id > rep").select("_id", "_th").withColumn("_key", key))
    docs = docs.withColumn("_key", key)
    release(spark)
    known = written(repeated_anchors(docs))
    release(spark)
    total = known.agg(F.sum("n")).first()[0] or 0
    hits = _anchor_rows(docs, True).join(known.select("anchor", (F.col("n") > HOT).alias("hot")), "anchor")
    hits = hits.groupBy("id").agg(F.collect_list("place").alias("places"), F.collect_list("hot").alias("hots"))
    # (_key, _th) stands for (_id, _th), so that one shuffle of the texts serves both joins
    texts = docs.join(copies, ["_key", "_th"], "left_anti").select("_id", "_th", "_key", "text")
    cut = texts.join(hits, texts["_key"] == hits["id"]).select("_id", "_th", "text", "places", "hots").mapInArrow(_cut_runs, _RUNS)
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(base, int(total * 220 / SHARD_BYTES))
    found = cut.repartition(shards, "key").mapInArrow(_search_shard, _RUNS).select("id", "th", "start", "n")
    whole = copies.select(F.col("_id").alias("id"), F.col("_th").alias("th"), F.lit(0).alias("start"), F.lit(None).cast("int").alias("n"))
    found = written(found.union(whole).groupBy("id", "th").agg(F.collect_list(F.struct("start", F.coalesce("n", F.lit(-1)).alias("n"))).alias("found")))
    release(spark)
    return found.select("id", "th", F.col("found.start").alias("starts"), F.col("found.n").alias("ns"))


def covered(n_words: int, starts: list[int] | None, ns: list[int] | None) -> np.ndarray:
    """Which words the repeated windows cover; n of -1 stands for all windows."""
    edge = np.zeros(n_words + 1, np.int64)
    for start, n in zip(starts or (), ns or (), strict=True):
        if n < 0:
            n = max(0, n_words - WINDOW + 1)
        if n:
            edge[start] += 1
            edge[start + n + WINDOW - 1] -= 1
    return np.cumsum(edge)[:-1] > 0


def _joined(docs: DataFrame) -> DataFrame:
    found = repeats(docs)
    return with_identity(docs).join(found, (F.col("_id") == F.col("id")) & (F.col("_th") == F.col("th")), "left")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""

    def make():
        def many(doc_ids, texts, starts, ns):
            out = []
            for text, s, n in zip(texts, starts, ns, strict=True):
                own = words(text)
                gone = covered(len(own), s, n)
                kept = own if not gone.any() else [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
                out.append((len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            return doc_ids, *(zip(*out, strict=True) if out else ((), (), ()))

        return many

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    return per_batch(_joined(docs.select("doc_id", "text")), schema, make, ["doc_id", "text", "starts", "ns"])


def keep_novel(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; ``n_chars``, where there, follows.

    What stands between two kept words stays; where words were cut, one line break does.
    """
    import re

    columns, kept = docs.columns, docs.schema
    at, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
    names = [f"_c{k}" for k in range(len(columns))]  # the added columns can't clash
    plain = with_identity(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)]), names[columns.index("doc_id")], names[at])
    found = repeats(docs)
    both = plain.join(found, (F.col("_id") == F.col("id")) & (F.col("_th") == F.col("th")), "left")

    def make():
        word = re.compile(r"[^\x20\x09-\x0D]+")

        def edit(text, starts, ns):
            spans = [m.span() for m in word.finditer(text)]
            gone = covered(len(spans), starts, ns)
            if not gone.any():
                return text
            parts, stay = [], ~gone
            edges = np.nonzero(np.diff(np.concatenate([[False], stay, [False]]).astype(np.int8)))[0]
            for a, z in zip(edges[::2], edges[1::2], strict=True):
                parts.append(text[spans[a][0] : spans[z - 1][1]])
            return "\n".join(parts)

        def many(*values):
            *own, starts, ns = values
            own[at] = [t if s is None else edit(t, s, n) for t, s, n in zip(own[at], starts, ns, strict=True)]
            if chars is not None:
                own[chars] = [old if s is None else len(t) for old, t, s in zip(own[chars], own[at], starts, strict=True)]
            return tuple(own)

        return many

    return per_batch(both, kept, make, [*names, "starts", "ns"], rows=512)
