"""Best-fit packing by patterns and non-negative least squares.

Documents become pieces of at most ``seq_len`` tokens. Only the histogram of piece
lengths (``seq_len`` bins at most) goes to the driver. There, patterns of one to four
lengths that nearly fill a sequence are enumerated, their repeat counts are fitted to
the histogram by non-negative least squares, rounded down to what the histogram
holds, and the residual counts are packed best fit, longest first, again by counts.
Each piece then finds its place from its length and its rank among the pieces of
that length; ranks are taken within hashed buckets, so no length is one task's.

Defined results: a null or empty text has the end id only; repeated rows are packed
one by one; an empty table has no pieces; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_tool, per_batch, written

#: Words whose ids a Python worker remembers, in each of two generations, and the characters of one, at most.
CACHE_WORDS, CACHE_CHARS = 150_000, 48
#: Bytes of text that are tokenized together (one text at least).
BLOCK_BYTES = 8_000_000
#: Patterns enumerated, at most, for each length that opens them.
PARTNERS = 12

_PLACE = 1 << 40
_TAIL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: What Arrow's and Python's white space has and the vocabulary's lacks.
_SYMBOLS = r"[\x1c-\x1f]"
_SIGN = np.array([max(0, _TAIL.find(chr(b))) for b in range(256)])
_LATIN = r"^[\x00-\x{12f}]*$"


class Ragged:
    """Rows of different lengths, in one array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes, self.first = flat, sizes, np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, rows: list[bytes]) -> Ragged:
        return cls(np.frombuffer(b"".join(rows), "<u4"), np.fromiter(map(len, rows), np.int64, len(rows)) // 4)

    def take(self, index: np.ndarray) -> Ragged:
        n = self.sizes[index]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        return Ragged(self.flat[np.arange(total) + np.repeat(self.first[index] - (end - n), n)], n)


class WordIds:
    """Ids of whole texts through a memory of words.

    The vocabulary's pre-tokenizer never joins what white space separates, so a text's
    ids are those of its parts in turn. Arrow splits a block of texts, numbers its
    distinct parts and takes the signs after a word off, so that Python sees each
    distinct lower-cased word once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin and the last one's end."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if pc.any(pc.match_substring_regex(texts, _SYMBOLS)).as_py():
            parts = pc.split_pattern(texts, " ")
        else:
            parts = pc.utf8_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        found = self.parts(coded.dictionary).take(coded.indices.to_numpy())
        edge = parts.offsets.to_numpy()
        return found.flat, np.concatenate([[0], np.cumsum(found.sizes)])[edge - edge[0]]

    def parts(self, parts: pa.StringArray) -> Ragged:
        """Ids of each of these distinct parts."""
        # letters are one pre-token, and so are the signs after them; below U+0130 a letter is in normal form
        bare = pc.utf8_rtrim(parts, _TAIL)
        plain = pc.and_(pc.utf8_is_alpha(bare), pc.match_substring_regex(bare, _LATIN))
        words = pc.if_else(plain, pc.utf8_lower(bare), parts).dictionary_encode()
        extra = (pc.binary_length(parts).to_numpy() - pc.binary_length(bare).to_numpy()) * plain.to_numpy(zero_copy_only=False)
        # one sign is told by its byte, which most tails are
        _, offsets, data = parts.buffers()
        last = np.frombuffer(offsets, np.int32)[parts.offset + 1 : parts.offset + len(parts) + 1] - 1
        signs = _SIGN[np.frombuffer(data, np.uint8)[last[extra == 1]]]
        several = np.nonzero(extra > 1)[0]
        tails = pa.array([x[-n:] for x, n in zip(parts.take(pa.array(several)).to_pylist(), extra[several].tolist(), strict=True)], pa.string()).dictionary_encode()
        names = words.dictionary.to_pylist()
        table = Ragged.of(self.words([*names, *_TAIL, *tails.dictionary.to_pylist(), ""]))
        tail = np.full(len(parts), len(table.sizes) - 1)
        tail[extra == 1] = len(names) + signs
        tail[several] = len(names) + len(_TAIL) + tails.indices.to_numpy()
        both = table.take(np.stack([words.indices.to_numpy(), tail], axis=1).ravel())
        return Ragged(both.flat, both.sizes.reshape(-1, 2).sum(axis=1))

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each of these words."""
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {"": b""}, self.young
        young, old = self.young.get, self.old.get
        out = list(map(young, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        todo = []
        for k in missing:
            out[k] = ids = old(words[k])
            if ids is None:
                todo.append(k)
        # words of letters are one pre-token each, so a line of them is told apart again by its pre-tokens
        single = [k for k in todo if words[k].isalpha() and max(words[k]) < "\u0130"]
        lines = [single[n : n + 512] for n in range(0, len(single), 512)]
        for line, got in zip(lines, self.encode([" ".join([words[k] for k in line]) for line in lines]), strict=True):
            raw = np.array(got.ids, "<u4").tobytes()
            edge = (4 * np.searchsorted(np.array(got.word_ids), np.arange(len(line) + 1))).tolist()
            for k, a, z in zip(line, edge, edge[1:], strict=False):
                out[k] = raw[a:z]
        others = sorted(set(todo).difference(single))
        for k, got in zip(others, self.encode([words[k] for k in others]), strict=True):
            out[k] = np.array(got.ids, "<u4").tobytes()
        self.young.update({words[k]: out[k] for k in missing if len(words[k]) <= CACHE_CHARS})
        return out

    def encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)


def _blocks(texts: pa.Array) -> Iterator[slice]:
    """Runs of rows of at most BLOCK_BYTES of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, "right")))
        yield slice(at, stop)
        at = stop


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str, seq_len: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each whole text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids, last = kept_tool(("packing", path), lambda: WordIds(path)), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows in _blocks(batch.column(1)):
                part = batch.slice(rows.start, rows.stop - rows.start)
                flat, edge = word_ids(part.column(1))
                raw, ends = memoryview(flat.tobytes()), edge.tolist()
                out = []
                for doc_id, a, z in zip(part.column(0).to_pylist(), ends, ends[1:], strict=False):
                    n = z - a + 1
                    for k, at in enumerate(range(0, n, seq_len)):
                        stop = min(at + seq_len, n)
                        crc = zlib.crc32(raw[4 * (a + at) : 4 * min(a + stop, z)])
                        out.append((doc_id, k, at, stop - at, crc if stop < n else zlib.crc32(last, crc)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


def patterns(lengths: list[int], counts: dict[int, int], seq_len: int) -> list[tuple[int, ...]]:
    """Few-document patterns: sums as near ``seq_len`` as the lengths at hand allow.

    For each length, alone and with up to ``PARTNERS`` second (and third) lengths
    spread over those that fit, the rest goes to the longest length that fits, and
    once more.
    """
    found = set()

    def close(start: tuple[int, ...], room: int, more: int) -> None:
        while more and room > 0:
            k = bisect_left(lengths, room + 1) - 1
            if k < 0:
                break
            start, room, more = (*start, lengths[k]), room - lengths[k], more - 1
        found.add(tuple(sorted(start, reverse=True)))

    for a in lengths:
        room = seq_len - a
        close((a,), room, 3)
        fit = lengths[: bisect_left(lengths, room + 1)]
        if fit:
            often = sorted(fit, key=lambda x: (-counts[x], x))[:PARTNERS]
            spread = fit[:: max(1, len(fit) // PARTNERS)]
            for b in {*often, *spread}:
                close((a, b), room - b, 2)
    return sorted(found, key=lambda p: (sum(p), -len(p), p), reverse=True)


def nnls(columns: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = 40) -> np.ndarray:
    """min ||A x - h||, x >= 0, by cyclic coordinate descent; column p of A counts the lengths in pattern p."""
    index = {length: k for k, length in enumerate(sorted(counts))}
    left = [float(counts[length]) for length in sorted(counts)]
    sparse = []
    for p in columns:
        rows: dict[int, int] = {}
        for length in p:
            rows[index[length]] = rows.get(index[length], 0) + 1
        sparse.append((tuple(rows.items()), sum(v * v for v in rows.values())))
    x = [0.0] * len(columns)
    total = sum(left) or 1.0
    for _ in range(sweeps):
        moved = 0.0
        for j, (rows, norm) in enumerate(sparse):
            step = 0.0
            for i, v in rows:
                step += v * left[i]
            new = x[j] + step / norm
            if new < 0.0:
                new = 0.0
            if (step := new - x[j]) != 0.0:
                x[j] = new
                moved += abs(step)
                for i, v in rows:
                    left[i] -= v * step
        if moved < 1e-3 * total:
            break
    return np.array(x)


def best_fit(counts: dict[int, int], seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of whole counts: (pattern, number of sequences)."""
    room_of: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = seq_len - sum(pattern)
        if room not in room_of:
            room_of[room] = []
            insort(rooms, room)
        room_of[room].append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                per = seq_len // length
                if left // per:
                    put((length,) * per, left // per)
                if left % per:
                    put((length,) * (left % per), 1)
                break
            room = rooms[k]
            pattern, n = room_of[room].pop()
            if not room_of[room]:
                del room_of[room]
                rooms.pop(k)
            used = min(n, left)
            if n > used:
                put(pattern, n - used)
            put((*pattern, length), used)
            left -= used
    return [group for room in sorted(room_of) for group in room_of[room]]


#: Shares of the fit that are tried: rounded in full, it can use up the short lengths that the residual needs.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25)


def fit(counts: dict[int, int], seq_len: int) -> list[tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]]:
    """For each of SHARES: the fitted patterns with their rounded repeat counts, and the counts that are left."""
    # only patterns that fill a sequence are fitted; the rest is the residual's
    columns = [p for p in patterns(sorted(counts), counts, seq_len) if sum(p) >= seq_len - seq_len // 512]
    fitted = nnls(columns, counts) if columns else np.zeros(0)
    order = sorted(range(len(columns)), key=lambda j: (-sum(columns[j]), -fitted[j], columns[j]))
    out = []
    for share in SHARES:
        rest, groups = dict(counts), []
        for j in order:
            p, n = columns[j], int(share * fitted[j] + 0.5)
            if n:
                n = min(n, *(rest[length] // p.count(length) for length in p))
            if n > 0:
                groups.append((p, n))
                for length in p:
                    rest[length] -= n
        out.append((groups, {k: v for k, v in rest.items() if v}))
    return out


def plan(counts: dict[int, int], seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many sequences follow each; together they use every count up.

    Fitted patterns come first, of the share that leads to the fewest sequences, then
    the residual's.
    """
    left = {k: int(v) for k, v in counts.items() if v > 0}
    whole = [((seq_len,), left.pop(seq_len))] if seq_len in left else []
    found = [groups + best_fit(rest, seq_len) for groups, rest in fit(left, seq_len)]
    return whole + min(found, key=lambda groups: sum(n for _, n in groups))


def places(groups: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the ranks of each length: sorted keys (length and first rank), first sequence, offset."""
    key, sequence, offset = [], [], []
    used: dict[int, int] = {}
    first = 0
    for pattern, n in groups:
        at = 0
        for length in pattern:
            rank = used.get(length, 0)
            key.append(length * _PLACE + rank)
            sequence.append(first)
            offset.append(at)
            used[length] = rank + n
            at += length
        first += n
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (key, sequence, offset))


def ranked(df: DataFrame, rows: int) -> DataFrame:
    """Adds ``rank`` (from 0, without gaps) among the rows of each length; ``row`` tells rows apart."""
    n = max(256, rows // 50_000)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64("row"), F.lit(n)))
    sizes = df.groupBy("length", "_bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("row")) - 1
    df = df.withColumn("_own", own).join(sizes, ["length", "_bucket"])
    return df.withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_bucket")


def pack(cut: DataFrame, seq_len: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces with ``row``, which is read three times."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    key, sequence, offset = places(plan(counts, seq_len))
    sent = cut.sparkSession.sparkContext.broadcast((key, sequence, offset))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]

    def make():
        key, sequence, offset = sent.value

        def many(doc_id, piece, start, length, crc, rank):
            if not rank:
                return (), (), (), (), (), (), ()
            want = np.array(length, np.int64) * _PLACE + np.array(rank, np.int64)
            k = np.searchsorted(key, want, "right") - 1
            return doc_id, piece, start, length, crc, sequence[k] + want - key[k], offset[k]

        return many

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return per_batch(ranked(cut, sum(counts.values())), schema, make, columns, rows=8192)


def pack_documents(docs: DataFrame, path: str, seq_len: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenize, cut and pack ``docs``: one row per piece."""
    # numbered before the write, so a row's number is the same for every reader
    cut = written(pieces(docs, path, seq_len, end_id).withColumn("row", F.monotonically_increasing_id()))
    return pack(cut, seq_len)
