"""A kept lexical index: postings in order of impact, in blocks with known bounds.

Evidence is dealt into shards by claim, so that all of a claim is in one; each shard is
turned over in one task and its postings are written in order of term bucket and term.
Postings of a term stand in blocks, those of greatest weight first; a block carries
the largest frequency in it and the smallest length a hit, from which follows what a
text of the block can score at most, whatever the averages of the day are.

A search reads the postings of its words only. A task takes in shards until it holds a
number of postings, walks the blocks of the rarest group of a request, looks the other
words up, and stops once no block left can beat the k-th best of all that it has seen. Later evidence is added as further shards: the
tables change as one unit, and nothing that is there is written again.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stem import stem, stemmed
from ..sources import units
from ..sources.scratch import written
from .retrieval import DEPTH, K1, STOP_WORDS, B, rank_hits, terms_of, websearch_terms
from .retrieval import half_up as rounded

#: Characters of a shard, about; its texts at least while there are tasks to be had; postings of a block; buckets of terms.
SHARD_CHARS, LEAST, BLOCK, BUCKETS = 4_000_000, 64, 128, 1024
#: Partitions at most, each with one shard after another; requests' words that are sent to every task at most; requests of a block.
PARTS, WORDS, REQUESTS = 20_000, 100_000, 256
#: Postings and places of them that a search looks at together, about: shards are taken in until they hold as many.
HELD = 1_000_000
_INTS = ("docs", "owners", "tfs", "sizes", "positions")
_POSTINGS = "bucket int, shard int, term string, block int, n int, max_tf int, min_ratio double, " + ", ".join(f"{c} array<int>" for c in _INTS)
#: Bucket of the row that holds a shard's counts: texts with a word as n, all their words as max_tf, whether they are stems as block.
_COUNTS = -1


def weight(tf, size, average: float):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))


def bound(max_tf: int, min_ratio: float, average: float) -> float:
    """At least the weight of any posting with at most ``max_tf`` hits and at least ``min_ratio`` words a hit."""
    return (K1 + 1) / (1 + K1 * (1 - B) / max_tf + K1 * B * min_ratio / average)


def add_evidence(spark: SparkSession, root: str, batch: int, evidence: DataFrame, stems: bool = False, live: DataFrame | None = None) -> bool:
    """Add ``evidence`` (claim_id, evidence_id, text) to the index at ``root``; False if that batch is in already.

    With ``live`` (claim_id), only the evidence of those claims: they are sent to the
    shards with the texts, which so are moved once. A claim's evidence must come in one
    batch. ``stems`` must be the same for all batches.
    """
    known = units.manifests(spark, root)
    if batch in known:
        return False
    rows = evidence.select(F.col("claim_id").cast("string").alias("claim_id"), F.lit(1).alias("kind"), F.col("evidence_id").cast("string").alias("evidence_id"), "text")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(1, -(-chars // SHARD_CHARS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // LEAST))
    parts, first, checked = min(shards, PARTS), _next_shard(spark, root, known), live is not None

    def dealt(texts: DataFrame) -> DataFrame:
        if live is not None:
            marks = live.select(F.col("claim_id").cast("string").alias("claim_id"), F.lit(0).alias("kind")).distinct()
            texts = texts.unionByName(marks, allowMissingColumns=True)
        numbered = texts.withColumn("shard", F.pmod(F.xxhash64("claim_id"), F.lit(shards)).cast("int"))
        return numbered.repartitionById(parts, F.pmod("shard", F.lit(parts))).sortWithinPartitions("shard", "claim_id", "kind", "evidence_id")

    stop = frozenset(STOP_WORDS)
    words = dealt(rows).select("shard", "claim_id", "kind", terms_of(F.col("text")).alias("words"))
    postings = words.mapInArrow(lambda b: _turned(b, first, stop, stems, checked), _POSTINGS)
    ids = dealt(rows.drop("text")).select("shard", "claim_id", "kind", "evidence_id")
    docs = ids.mapInArrow(lambda b: _numbered(b, first, checked), "shard int, doc int, owner int, first boolean, claim_id string, evidence_id string")
    return units.commit(spark, root, batch, {"postings": units.Change(postings), "docs": units.Change(docs)})


def _counts(spark: SparkSession, root: str, known: dict[int, dict]) -> DataFrame:
    """shard, n_docs, n_words, stems: the row that each shard has for its counts."""
    rows = units.read(spark, root, "postings", _POSTINGS, known=known).filter(F.col("bucket") == _COUNTS)
    return rows.select("shard", F.col("n").alias("n_docs"), F.col("max_tf").cast("bigint").alias("n_words"), (F.col("block") == 1).alias("stems"))


def _next_shard(spark: SparkSession, root: str, known: dict[int, dict]) -> int:
    last = _counts(spark, root, known).agg(F.max("shard")).first()[0] if known else None
    return 0 if last is None else last + 1


def _numbers(claims: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Number of each row's claim, for rows in order of claim."""
    code = (claims.combine_chunks() if isinstance(claims, pa.ChunkedArray) else claims).dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.cumsum(np.concatenate([[0], (np.diff(code) != 0).astype(np.int64)])) if len(code) else np.zeros(0, np.int64)


def _by_shard(batches: Iterator[pa.RecordBatch], checked: bool) -> Iterator[pa.Table]:
    """Rows (shard, claim_id, kind, ...) in order, as one table a shard: the texts, and if that is ``checked`` those of marked claims alone."""
    for rows in _gathered(batches):
        text = rows["kind"].to_numpy() == 1
        if checked:
            owner = _numbers(rows["claim_id"])
            text &= np.isin(owner, owner[~text])
        if text.any():
            yield rows.filter(pa.array(text))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, now = [], None
    for b in batches:
        shard = b.column(0).to_numpy()
        edges = [0, *(np.nonzero(np.diff(shard))[0] + 1).tolist(), b.num_rows]
        for a, z in itertools.pairwise(edges):
            if z > a:
                if shard[a] != now and held:
                    yield pa.Table.from_batches(held)
                    held = []
                now = shard[a]
                held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _numbered(batches: Iterator[pa.RecordBatch], first: int, checked: bool) -> Iterator[pa.RecordBatch]:
    for rows in _by_shard(batches, checked):
        shard = pa.array(rows["shard"].to_numpy() + first, pa.int32())
        owner = _numbers(rows["claim_id"])
        numbers = [pa.array(x.astype(np.int32)) for x in (np.arange(rows.num_rows), owner)]
        leads = pa.array(np.diff(owner, prepend=-1) > 0)
        columns = [shard, *numbers, leads, rows["claim_id"], rows["evidence_id"]]
        yield from pa.Table.from_arrays(columns, names=["shard", "doc", "owner", "first", "claim_id", "evidence_id"]).to_batches(max_chunksize=8192)


def _turned(batches: Iterator[pa.RecordBatch], first: int, stop: frozenset[str], stems: bool, checked: bool) -> Iterator[pa.RecordBatch]:
    for rows in _by_shard(batches, checked):
        yield from _blocks(rows, first, stop, stems)


def _blocks(rows: pa.Table, first: int, stop: frozenset[str], stems: bool) -> Iterator[pa.RecordBatch]:
    """One shard's texts, in the order of their numbers, as blocks of postings."""
    shard = rows["shard"][0].as_py() + first
    words = rows["words"].combine_chunks()
    sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    position = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = words.flatten().dictionary_encode()
    names = [None if w in stop else stem(w) if stems else w for w in coded.dictionary.to_pylist()]
    # terms are numbered in the order in which they are written: by bucket, then by their bytes
    known = pa.array(names, pa.string()).dictionary_encode()
    crc = np.array([zlib.crc32(w.encode()) % BUCKETS for w in known.dictionary.to_pylist()], np.int32)
    order = pc.sort_indices(pa.table({"bucket": crc, "term": known.dictionary}), [("bucket", "ascending"), ("term", "ascending")])
    terms, bucket = known.dictionary.take(order), crc[order.to_numpy()]
    place = np.empty(len(order) + 1, np.int64)
    place[order.to_numpy()], place[-1] = np.arange(len(order)), -1
    term = place[known.indices.fill_null(-1).to_numpy()][coded.indices.to_numpy()]
    order = np.argsort(term, kind="stable")
    order = order[np.searchsorted(term[order], 0) :]
    term, doc, position = term[order], doc[order], position[order]
    if not len(term):
        return
    start = np.concatenate([[0], np.nonzero((np.diff(term) != 0) | (np.diff(doc) != 0))[0] + 1])
    tf = np.diff(np.append(start, len(term)))
    t, d = term[start], doc[start]
    with_words = np.unique(d)
    impact = weight(tf, sizes[d], sizes[with_words].mean())
    best = np.lexsort((d, -impact, t))
    t, d, tf, start = t[best], d[best], tf[best], start[best]
    spots = position[np.repeat(start - (np.cumsum(tf) - tf), tf) + np.arange(tf.sum())]
    place_in_term = np.arange(len(t)) - np.searchsorted(t, t)
    edge = np.nonzero(place_in_term % BLOCK == 0)[0]
    counts = np.diff(np.append(edge, len(t)))
    lists = pa.array(np.append(edge, len(t)).astype(np.int32))
    ends = np.append(0, np.cumsum(tf))[np.append(edge, len(t))]
    owner = _numbers(rows["claim_id"])
    each = [pa.ListArray.from_arrays(lists, pa.array(x.astype(np.int32))) for x in (d, owner[d], tf, sizes[d])]
    each.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(spots.astype(np.int32))))
    numbers = [bucket[t[edge]], np.full(len(edge), shard), place_in_term[edge] // BLOCK, counts, np.maximum.reduceat(tf, edge)]
    numbers = [*[pa.array(x.astype(np.int32)) for x in numbers], pa.array(np.minimum.reduceat(sizes[d] / tf, edge))]
    columns = [*numbers[:2], terms.take(pa.array(t[edge])), *numbers[2:], *each]
    names_of = ["bucket", "shard", "term", "block", "n", "max_tf", "min_ratio", *_INTS]
    total = [_COUNTS, shard, "", int(stems), len(with_words), int(sizes[with_words].sum()), 0.0, [], [], [], [], []]
    table = pa.Table.from_arrays(columns, names=names_of)
    yield from table.to_batches(max_chunksize=4096)
    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(total, table.schema, strict=True)], names=names_of)


class Term:
    """A word's postings in some shards, in blocks by falling bound; they are put together when they are first looked at.

    Texts and claims have their shard's number in the upper half of theirs.
    """

    def __init__(self, rows: list[dict], average: float):
        bounds = bound(np.array([r["max_tf"] for r in rows]), np.array([r["min_ratio"] for r in rows]), average)
        falling = np.argsort(-bounds, kind="stable")
        self.average, self.rows, self.bounds = average, [rows[k] for k in falling], bounds[falling]
        self.edges = np.append(0, np.cumsum([r["n"] for r in self.rows]))
        self.most, self.size = float(self.bounds[0]), int(self.edges[-1])

    def _all(self, column: str) -> np.ndarray:
        return np.concatenate([r[column] for r in self.rows])

    @cached_property
    def _shards(self) -> np.ndarray:
        return np.repeat(np.array([r.get("shard", 0) for r in self.rows], np.int64) << 32, np.diff(self.edges))

    @cached_property
    def docs(self) -> np.ndarray:
        return self._all("docs") + self._shards

    @cached_property
    def owners(self) -> np.ndarray:
        return self._all("owners") + self._shards

    @cached_property
    def tfs(self) -> np.ndarray:
        return self._all("tfs")

    @cached_property
    def weights(self) -> np.ndarray:
        return weight(self.tfs, self._all("sizes"), self.average)

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.docs)

    @cached_property
    def sorted(self) -> np.ndarray:
        return self.docs[self.order]

    @cached_property
    def ends(self) -> np.ndarray:
        return np.append(0, np.cumsum(self.tfs))

    @cached_property
    def spots(self) -> np.ndarray:
        return self._all("positions")

    def find(self, docs: np.ndarray) -> np.ndarray:
        """Place of each text's posting, or -1."""
        at = np.minimum(np.searchsorted(self.sorted, docs), self.size - 1)
        return np.where(self.sorted[at] == docs, self.order[at], -1)

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the word stands in the texts of postings: number of the posting in ``at``, and place."""
        n = self.tfs[at]
        of = np.repeat(np.arange(len(at)), n)
        return of, self.spots[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.ends[at][of]].astype(np.int64)


class Request:
    """The parts of a request, put in order once for all shards."""

    def __init__(self, parts: list[dict]):
        alts: dict[tuple[int, int, bool], list[tuple[int, str]]] = {}
        self.idf: dict[str, float] = {}
        for p in parts:
            alts.setdefault((p["grp"], p["alt"], p["negated"]), []).append((p["phrase_pos"], p["term"]))
            if not p["negated"]:
                self.idf[p["term"]] = p["idf"]
        self.groups: dict[int, list[list[tuple[int, str]]]] = {}
        for (grp, _, negated), words in alts.items():
            if not negated:
                self.groups.setdefault(grp, []).append(words)
        self.without = [words for (_, _, negated), words in alts.items() if negated]


class Shard:
    """The postings of some words in one shard or more."""

    def __init__(self, average: float):
        self.average, self.rows, self.terms, self.gone = average, {}, {}, set()
        self.read = self.skipped = self.held = 0

    def add(self, word: str, row: dict) -> None:
        self.rows.setdefault(word, []).append(row)
        self.held += row["n"] + len(row["positions"])

    def term(self, word: str) -> Term | None:
        if word not in self.terms:
            self.terms[word] = Term(self.rows.pop(word), self.average) if word in self.rows else None
        return self.terms[word]

    def holds(self, words: list[tuple[int, str]], docs: np.ndarray) -> np.ndarray:
        """Whether a word, or a phrase of words at their distances, is in each text."""
        found = [self.term(w) for _, w in words]
        if any(t is None for t in found):
            return np.zeros(len(docs), bool)
        at = np.stack([t.find(docs) for t in found])
        ok = (at >= 0).all(axis=0)
        if len(words) > 1 and ok.any():
            at, starts = at[:, ok], None
            for own, (off, _), t in zip(at, words, found, strict=True):
                of, place = t.places(own)
                # a text and where the phrase would begin in it, as one number; it can begin before the text by its own length
                begin = (of << 32) + place - off + 2**31
                starts = begin if starts is None else starts[np.isin(starts, begin)]
            here = np.zeros(at.shape[1], bool)
            here[starts >> 32] = True
            ok[ok] = here
        return ok

    def best(self, parts: list[dict] | Request, k: int, digits: int | None, kth: float = -np.inf) -> list[tuple[int, float]]:
        """The k best claims of a request: (number, score), equal scores by number; those only that reach ``kth``, the k-th best of other shards.

        Of scores equal to the last, whose names decide, each shard gives its first k.
        """
        asked = parts if isinstance(parts, Request) else Request(parts)
        idf, groups = asked.idf, asked.groups
        most = {w: idf[w] * t.most for w in idf if (t := self.term(w)) is not None}
        slack = 0.0 if digits is None else 2 * 10.0**-digits
        if not groups or sum(most.values()) < kth - slack - 1e-9:
            return []

        def rarest(words: list[tuple[int, str]]) -> str | None:
            """Of the words that must all be there, the one in the fewest texts; None where one is in none."""
            sizes = [(t.size, w) if (t := self.term(w)) is not None else None for _, w in words]
            return None if None in sizes else min(sizes)[1]

        leads = {g: {w for words in some if (w := rarest(words)) is not None} for g, some in groups.items()}
        if not all(leads.values()):
            return []
        lead = min(leads.values(), key=lambda ws: sum(self.term(w).size for w in ws))
        lead = sorted(lead, key=lambda w: (-most[w], w))
        gone = np.fromiter(self.gone, np.int64)
        scores: dict[int, float] = {}
        for n, w in enumerate(lead):
            # a text with a word whose turn was earlier has been looked at, or can't be among the best
            t, rest, step = self.term(w), sum(m for x, m in most.items() if x not in lead[: n + 1]), 1
            limits, block = idf[w] * t.bounds + rest, 0
            while left := np.count_nonzero(limits[block:] >= kth - slack - 1e-9):
                to, step = block + min(step, left), step * 4
                at = np.arange(t.edges[block], t.edges[to])
                self.read, block = self.read + to - block, to
                docs, total, ok = t.docs[at], np.zeros(len(at)), np.ones(len(at), bool)
                for x in sorted(most):
                    found = at if x == w else self.term(x).find(docs)
                    total += np.where(found >= 0, idf[x] * self.term(x).weights[found], 0.0)
                    if x in lead[:n]:
                        ok &= found < 0
                ok &= total >= kth - slack
                if len(gone):
                    ok &= ~np.isin(t.owners[at], gone)
                for some in groups.values():
                    if ok.any() and not any(words == [(0, w)] for words in some):
                        ok[ok] = np.any([self.holds(words, docs[ok]) for words in some], axis=0)
                for words in asked.without:
                    if ok.any():
                        ok[ok] = ~self.holds(words, docs[ok])
                for o, s in zip(t.owners[at[ok]].tolist(), total[ok].tolist(), strict=True):
                    scores[o] = max(s, scores.get(o, s))
                if len(scores) >= k:
                    kth = max(kth, np.partition(np.fromiter(scores.values(), float), len(scores) - k)[len(scores) - k])
                    if len(scores) > 4 * k:
                        scores = {o: s for o, s in scores.items() if s >= kth - slack}
            self.skipped += len(limits) - block
        ranked = sorted((-rounded(s, digits), o) for o, s in scores.items() if s >= kth - slack)
        last, equal, out = ranked[k - 1][0] if len(ranked) >= k else np.inf, Counter(), []
        for s, o in ranked:
            equal[o >> 32] += s == last
            if s < last or s == last and equal[o >> 32] <= k:
                out.append((o, -s))
        return out


def best_of(hits: list[tuple[float, int, int]], k: int) -> list[tuple[float, int, int]]:
    """The k best of (score, shard, number), and those as good as the last: whose names decide comes later."""
    hits.sort(key=lambda h: -h[0])
    return [h for h in hits if h[0] >= hits[k - 1][0]] if len(hits) > k else hits


def search_index(spark: SparkSession, root: str, queries: DataFrame, k: int = DEPTH, digits: int | None = None, gone: DataFrame | None = None) -> DataFrame:
    """As ``lexical_search``, from the index at ``root``: query_id, arm, claim_id, rank, raw.

    Claims of ``gone`` (claim_id), closed since they were added, are left out; the
    statistics still count them.
    """
    known_units = units.manifests(spark, root)
    shards = _counts(spark, root, known_units).agg(F.sum("n_docs"), F.sum("n_words"), F.max("stems"), F.max("shard")).first()
    kind = queries.schema["query_id"].dataType.simpleString()
    if not shards[0]:
        return spark.createDataFrame([], f"query_id {kind}, arm string, claim_id string, rank int, raw double")
    n_docs, average, last = shards[0], shards[1] / shards[0], shards[3]
    asked = websearch_terms(queries)
    terms = asked.withColumn("term", stemmed(F.col("term"))) if shards[2] else asked
    in_phrase = F.count("*").over(Window.partitionBy("query_id", "alt")) > 1
    terms = written(terms.withColumn("bucket", (F.crc32("term") % BUCKETS).cast("int")).withColumn("in_phrase", in_phrase))
    n_requests, n_terms, buckets = terms.agg(F.count_distinct("query_id"), F.count_distinct("term"), F.collect_set("bucket")).first()  # BUCKETS at most
    wanted, few = terms.select("bucket", "term").distinct(), n_terms <= WORDS
    postings = units.read(spark, root, "postings", known=known_units).filter(F.col("bucket").isin(buckets))
    postings = written(postings.join(F.broadcast(wanted) if few else wanted, ["bucket", "term"], "left_semi"))
    df = postings.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = terms.join(F.broadcast(df) if few else df, "term", "left").withColumn("idf", F.coalesce(idf, F.lit(0.0)))
    part = F.struct("grp", "alt", "term", "phrase_pos", "negated", "idf", "in_phrase")
    # Requests are dealt by their most frequent word, so that its postings go to few blocks. More blocks leave fewer
    # parts to each, so what is found grows with the requests and not with the shards.
    lead = F.max(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("lead")
    requests = known.groupBy("query_id").agg(F.collect_list(part).alias("parts"), lead)
    blocks = max(1, -(-n_requests // REQUESTS))
    parts = max(1, min(last + 1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)))
    sharing = requests.groupBy(F.col("lead.term").alias("of")).agg(F.ceil(F.count("*") / REQUESTS).cast("bigint").alias("_n"))
    spread = requests.join(F.broadcast(sharing) if few else sharing, F.col("lead.term") == F.col("of"))
    dealt = spread.withColumn("_b", F.pmod(F.xxhash64("of", F.pmod(F.xxhash64("query_id"), F.col("_n"))), F.lit(blocks)).cast("int"))
    asks = written(dealt.select("_b", "query_id", "parts"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    # places in the texts serve phrases only, and are most of a posting
    wants = asks.select("_b", F.inline("parts")).groupBy("_b", "term").agg(F.max("in_phrase").alias("in_phrase"))
    spots = F.when(F.col("in_phrase"), F.col("positions")).otherwise(F.array().cast("array<int>")).alias("positions")
    held = ["term", "n", "max_tf", "min_ratio", *_INTS[:-1], spots]
    rows = postings.join(F.broadcast(wants) if n_terms * blocks <= WORDS else wants, "term").select("_b", "shard", F.lit(1).alias("kind"), *held)
    asks = asks.select("_b", every.alias("_p"), F.lit(-1).alias("shard"), F.lit(0).alias("kind"), "query_id", "parts")
    docs = units.read(spark, root, "docs", known=known_units)
    if gone is not None:
        closed = docs.join(gone.select(F.col("claim_id").cast("string").alias("claim_id")).distinct(), "claim_id", "left_semi")
        to_all = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        rows = rows.unionByName(closed.select(to_all.alias("_b"), "shard", F.lit(2).alias("kind"), F.array("owner").alias("owners")), allowMissingColumns=True)
    both = asks.unionByName(rows.withColumn("_p", F.pmod("shard", F.lit(parts))), allowMissingColumns=True)
    met = both.select((F.col("_b") * parts + F.col("_p")).alias("pair"), *[c for c in both.columns if c not in ("_b", "_p")])
    met = met.repartitionById(blocks * parts, "pair").sortWithinPartitions("pair", "shard", "kind")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # equal requests are answered once; what the shards before have found bounds what the next must look at
        now, pair, requests_here, shard, found = None, None, {}, Shard(average), {}

        def look() -> None:
            if shard.rows or shard.terms:
                for key, (wants, _) in requests_here.items():
                    known = found.get(key, [])
                    if hits := shard.best(wants, k, digits, known[k - 1][0] if len(known) >= k else -np.inf):
                        found[key] = best_of([*known, *((x, o >> 32, o & 0xFFFFFFFF) for o, x in hits)], k)

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(q, s, o, x) for key, hits in found.items() for q in requests_here[key][1] for x, s, o in hits]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (id_type, pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["query_id", "shard", "owner", "raw"])
            found.clear()

        for b in batches:
            cols = {c: b.column(c) for c in b.schema.names}
            id_type = cols["query_id"].type
            plain = {c: cols[c].to_pylist() for c in ("term", "n", "max_tf", "min_ratio")}
            lists = {c: (cols[c].offsets.to_pylist(), cols[c].values.to_numpy()) for c in _INTS}
            for n, (of, s, what) in enumerate(zip(*(cols[c].to_pylist() for c in ("pair", "shard", "kind")), strict=True)):
                if of != pair or s != now and shard.held >= HELD:
                    look()
                    shard = Shard(average)
                    if of != pair:
                        yield from flush()
                        requests_here = {}
                pair, now = of, s
                if what == 0:
                    wants = cols["parts"][n].as_py()
                    key = tuple(sorted(tuple(p.values()) for p in wants))
                    requests_here.setdefault(key, (Request(wants), []))[1].append(cols["query_id"][n].as_py())
                elif what == 1:
                    one = {"shard": s} | {c: plain[c][n] for c in ("n", "max_tf", "min_ratio")}
                    one |= {c: flat[ends[n] : ends[n + 1]] for c, (ends, flat) in lists.items()}
                    shard.add(plain["term"][n], one)
                else:
                    shard.gone.update((s << 32) + o for o in cols["owners"][n].as_py())
        look()
        yield from flush()

    found = met.mapInArrow(answer, f"query_id {kind}, shard int, owner int, raw double")
    # a claim is named by the first of its texts
    names = docs.filter("first").select("shard", "owner", "claim_id")
    near = found.withColumn("_n", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("raw")))).filter(F.col("_n") <= k).drop("_n")
    top = rank_hits(near.join(names, ["shard", "owner"]), [F.desc("raw"), F.col("claim_id")], k=k)
    return top.select("query_id", F.lit("lexical").alias("arm"), "claim_id", "rank", "raw")
