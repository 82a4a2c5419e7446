"""SimHash near-duplicates through pivot distance tables.

Each text gets a 64-bit fingerprint. Distinct fingerprints that differ in three bits
or fewer are linked; components of links are groups. Fingerprints meet in cells: of
four bands one is equal for any link, and of four parts of the other bits again one,
so 16 cells of 28 equal bits miss nothing. In a cell, a table of Hamming distances to
reference fingerprints discards pairs whose distances differ by more than three for
any reference (the triangle inequality), and the survivors are verified. A cell with
more than ``CELL`` fingerprints is dealt anew with more equal bits. At the fifth
level every cell is compared: 15 free bits bound it to 32,768. Equal fingerprints are one node from the
start, and a cell gives links of a spanning forest, never all pairs.

Defined results: null texts and texts without words have fingerprint 0, which links
like any other; a null doc_id takes part but never names a group unless all are
null; repeated rows get the same result; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, mix64, per_batch, written
from .graph import components

SEED, SHINGLE, LIMIT = 42, 3, 3
#: Distinct fingerprints that a task compares at once, at most, above the last level.
CELL = 4096
#: Level whose cells are all compared.
LAST = 5
#: Reference fingerprints: zero and fixed pseudo-random ones.
PIVOTS = np.concatenate([np.zeros(1, np.uint64), mix64(np.arange(1, 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))])

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 values of all word shingles, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[: -(SHINGLE - 1)].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], "<u8")
    n, octets = len(hashes), hashes.view(np.uint8).reshape(-1, 8)
    if n < 300:
        votes = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0)
    else:
        votes = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp``, the fingerprint's bits as a bigint."""

    def make():
        def many(keys, texts):
            found = np.array([fingerprint(t) for t in texts], np.uint64)
            return keys, found.view(np.int64)

        return many

    return per_batch(docs, f"{key} {docs.schema[key].dataType.simpleString()}, fp bigint", make, [key, text])


def _parts(free: list[int], n: int = 4) -> list[int]:
    """Masks that split these bit places into n runs."""
    cuts = [round(k * len(free) / n) for k in range(n + 1)]
    return [sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def masks(level: int) -> dict[int, list[int]]:
    """Masks of equal bits at a level, under the masks that they extend."""
    if level == 1:
        return {0: _parts(list(range(64)))}
    found: dict[int, list[int]] = {}
    for below in masks(level - 1).values():
        for mask in below:
            found[mask] = [mask | part for part in _parts([b for b in range(64) if not mask >> b & 1])]
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cell_links(fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of one cell (indices)."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    order = np.argsort(table[:, 1], kind="stable")
    alive = order  # not reached yet, sorted by distance to one pivot
    out: list[tuple[int, int]] = []
    while len(alive):
        queue, alive = [int(alive[0])], alive[1:]
        while queue and len(alive):
            q = queue.pop()
            first = table[alive, 1]
            a, z = np.searchsorted(first, (table[q, 1] - LIMIT, table[q, 1] + LIMIT + 1))
            near = np.arange(a, z)
            for k in range(len(PIVOTS)):
                if len(near) == 0:
                    break
                near = near[np.abs(table[alive[near], k] - table[q, k]) <= LIMIT]
            near = near[np.bitwise_count(fp[alive[near]] ^ fp[q]) <= LIMIT]
            if len(near):
                reached = alive[near].tolist()
                out += [(q, r) for r in reached]
                queue += reached
                alive = np.delete(alive, near)
    return out


def _small_links(key: np.ndarray, fp: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links in short runs of equal keys, for all runs at once."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    left, right = [], []
    for lag in range(1, int(run.max(initial=1))):
        i = np.nonzero(key[lag:] == key[:-lag])[0]
        if not len(i):
            break
        i = i[np.abs(table[i] - table[i + lag]).max(axis=1) <= LIMIT]
        i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= LIMIT]
        left.append(fp[i])
        right.append(fp[i + lag])
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


_SCHEMA = "u bigint, v bigint, mask bigint"


def _compare(batches: Iterator[pa.RecordBatch], cell: float) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp, mask) sorted by cell: links, and rows of cells of more than ``cell`` as (fp, null, mask)."""

    def batch(u, v, mask):
        u, v = np.asarray(u, np.uint64).view(np.int64), None if v is None else np.asarray(v, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(u, pa.int64()), pa.nulls(len(u), pa.int64()) if v is None else pa.array(v, pa.int64()), pa.nulls(len(u), pa.int64()) if mask is None else pa.array(mask, pa.int64())],
            names=["u", "v", "mask"],
        )

    def runs(key, fp, mask):
        """All rows of the cells that begin and end here."""
        edge = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
        size = np.diff(edge)
        short = np.repeat((size > 1) & (size <= 24), size)
        if short.any():
            u, v = _small_links(key[short], fp[short], size[(size > 1) & (size <= 24)])
            yield batch(u, v, None)
        for k in np.nonzero(size > 24)[0]:
            part = slice(edge[k], edge[k + 1])
            if size[k] > cell:
                yield batch(fp[part], None, mask[part])
            else:
                own = np.unique(fp[part])  # a cell can come from several larger ones
                if found := cell_links(own):
                    i = np.array(found)
                    yield batch(own[i[:, 0]], own[i[:, 1]], None)

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    over = None  # the cell whose rows pass through, as it has too many
    for b in batches:
        key, fp, mask = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        fp = fp.view(np.uint64)
        if over is not None:
            n = int(np.searchsorted(key, over, "right"))
            if n:
                yield batch(fp[:n], None, mask[:n])
            key, fp, mask = key[n:], fp[n:], mask[n:]
            if not len(key):
                continue
            over = None
        if held:
            key, fp, mask = (np.concatenate(x) for x in zip(*held, (key, fp, mask), strict=True))
            held = []
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last:
            yield from runs(key[:last], fp[:last], mask[:last])
        if len(key) - last > cell:
            yield batch(fp[last:], None, mask[last:])
            over = key[-1]
        elif len(key):
            held = [(key[last:], fp[last:], mask[last:])]
    if held:
        yield from runs(*held[0])


def links(distinct: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (u, v) between the rows of ``distinct(fp)`` whose components are those of all links."""
    spark = distinct.sparkSession
    todo = distinct.select("fp", F.lit(0).cast("bigint").alias("mask"))
    parts, level = [], 2
    while True:
        below = masks(level) if level > 2 else {0: [m for subs in masks(2).values() for m in subs]}
        rows = [(_signed(m), [_signed(s) for s in subs]) for m, subs in below.items()]  # 1,024 masks at most
        subs = F.broadcast(spark.createDataFrame(rows, "mask bigint, subs array<bigint>"))
        dealt = todo.join(subs, "mask").select("fp", F.explode("subs").alias("mask"))
        cells = dealt.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("cell"), "fp", "mask")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = written(cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(lambda b, most=cell if level < LAST else float("inf"): _compare(b, most), _SCHEMA))
        parts.append(found.filter("v is not null").select("u", "v"))
        todo = found.filter("v is null").select(F.col("u").alias("fp"), "mask").distinct()
        level += 1
        if level > LAST or todo.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints (doc_id, fp) and, for each fingerprint, ``component_id`` and how many rows have it."""
    prints = written(fingerprints(docs))
    first = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    found = components(links(first))
    named = first.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints, named.join(least, "root").select("fp", "component_id", "n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    prints, named = groups(docs)
    return join_hot(prints, written(named), ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows whose doc_id is the least of their group (all rows with that doc_id); columns as they were."""
    prints, named = groups(docs)
    kept = join_hot(prints, written(named), ["fp"], "n").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*docs.columns)
