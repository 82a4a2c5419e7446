"""Toxicity by compression distance.

Two zstandard dictionaries are made from a bounded labelled sample: one of windows of
toxic text, one of windows of ordinary text. A window is the opening of a word
(some letters after a space). It counts as a hit if it compresses to at most
``near`` bytes with the toxic dictionary and at least ``gap`` bytes worse with the
ordinary one; both thresholds are calibrated on the sample, as is the probability
that a text with so many hits is toxic, which is its score.

zstandard takes matches of four bytes or more and spends about three on each, so
each byte is written as four fixed pseudo-random ones first: lengths then tell how
much of a window a dictionary holds. The toxic dictionary has the windows that many
toxic texts bring in a context of their own (near copies bring none) and ordinary
texts hardly have; the ordinary one has the most frequent windows of ordinary text.
Both are used as raw content: the library's trainer drops rare windows.

Defined results: null and empty texts, and texts without a letter, have no hit and
the lowest score; whole texts are judged, long ones by their densest stretch; without toxic and ordinary samples every
score is 0; repeated rows get the same score; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, kept_tool, per_batch

#: Letters of a window: the width that separates the sample best is taken.
WIDTHS = (4, 5, 6)
EXPAND, LEVEL = 4, 12
#: Texts of each label that are learned from, at most, and the characters above which a text is not taken; those taken are whole.
TOXIC, ORDINARY, LONGEST = 800, 2400, 10_000
#: Windows of the ordinary dictionary, at most, and of a worker's memory.
COMMON, MEMORY = 12_000, 500_000
#: A toxic window is in this share of toxic texts (and in LEAST) and this much rarer in ordinary ones.
SHARE, LEAST, CONTRAST = 0.01, 3, 10.0
#: Hits beyond this many are scored alike; those of the stretch of so many consecutive windows that has most count.
MOST, UNIT = 4, 500

_OPENING = {n: re.compile(r"(?<![^\W\d_])[^\W\d_]{1,%d}" % n) for n in WIDTHS}
_CODE = [hashlib.blake2b(bytes([b]), digest_size=EXPAND).digest() for b in range(256)]


def windows(text: str | None, width: int) -> list[str]:
    """The first letters of each word."""
    return _OPENING[width].findall(text.lower()) if text else []


def expand(window: str, width: int) -> bytes:
    """A window as the compressor sees it: a space, the letters, a space if the word was shorter; each byte as four."""
    return b"".join(map(_CODE.__getitem__, (" " + window + " ")[: width + 1].encode("utf-8", "surrogatepass")))


def level(hits: np.ndarray) -> int:
    """What a text's score goes by: of whether each window is a hit, the hits of the densest stretch of UNIT windows.

    Text put before or after never lowers it.
    """
    if len(hits) > UNIT:
        sums = np.concatenate([[0], np.cumsum(hits)])
        return int(min(MOST, (sums[UNIT:] - sums[:-UNIT]).max()))
    return int(min(MOST, hits.sum()))


def own_contexts(texts: list[str], width: int) -> Counter:
    """For each window, the texts that have it after a window after which no earlier text had it."""
    seen: set[tuple[str, str]] = set()
    out: Counter = Counter()
    for text in texts:
        found = windows(text, width)
        new = {(a, b) for a, b in zip(["", *found], found, strict=False)} - seen
        out.update({b for _, b in new})
        seen |= new
    return out


@dataclass(frozen=True)
class Model:
    toxic: tuple[str, ...]
    ordinary: tuple[str, ...]
    width: int = WIDTHS[0]
    near: int = 0
    gap: int = 0
    scores: tuple[float, ...] = (0.0,) * (MOST + 1)


def _compressor(dictionary: tuple[str, ...], width: int):
    import zstandard as z

    how = z.ZstdCompressionParameters.from_level(
        LEVEL, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    data = z.ZstdCompressionDict(b"".join(expand(w, width) for w in dictionary), dict_type=z.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=how)
    return z.ZstdCompressor(dict_data=data, compression_params=how)


class Lengths(dict):
    """Window to its compressed lengths under the toxic and the ordinary dictionary."""

    def __init__(self, model: Model):
        super().__init__()
        self.width = model.width
        self.toxic, self.ordinary = _compressor(model.toxic, model.width), _compressor(model.ordinary, model.width)

    def __missing__(self, window: str) -> tuple[int, int]:
        if len(self) >= MEMORY:
            self.clear()
        raw = expand(window, self.width)
        found = self[window] = (len(self.toxic.compress(raw)), len(self.ordinary.compress(raw)))
        return found


class Hits(dict):
    """Window to 1 if it is a hit, else 0."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.lengths = model, Lengths(model)

    def __missing__(self, window: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        toxic, ordinary = self.lengths[window]
        found = self[window] = int(toxic <= self.model.near and ordinary - toxic >= self.model.gap)
        return found

    def of(self, text: str | None) -> np.ndarray:
        """For each window of a text whether it is a hit."""
        return np.fromiter(map(self.__getitem__, windows(text, self.model.width)), np.int64)

    def count(self, text: str | None) -> int:
        return int(self.of(text).sum())


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries, thresholds and scores from texts of both labels.

    Width, thresholds and scores come from the odd texts under dictionaries of the
    even ones; the dictionaries are then made from all.
    """
    if not toxic or not ordinary:
        return Model((), ())
    found = [_calibrated(toxic, ordinary, width) for width in WIDTHS]
    value, width, near, gap, scores = max(found, key=lambda x: x[0])
    bad, common = _contrast(toxic, ordinary, width)
    return Model(bad, common, width, near, gap, scores) if bad and value > 0 else Model((), ())


def _contrast(toxic: list[str], ordinary: list[str], width: int) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Windows of the toxic and of the ordinary dictionary."""
    bad, good = own_contexts(toxic, width), own_contexts(ordinary, width)
    rate = CONTRAST * len(toxic) / len(ordinary)
    marked = {w for w, n in bad.items() if n >= max(LEAST, SHARE * len(toxic)) and n >= rate * (good[w] + 0.5)}
    common = sorted((w for w in good if w not in marked), key=lambda w: (good[w], w))[-COMMON:]
    return tuple(sorted(marked, key=lambda w: (bad[w], w))), tuple(common)


def _calibrated(toxic: list[str], ordinary: list[str], width: int) -> tuple[float, int, int, int, tuple[float, ...]]:
    """Caught toxic less four times the caught ordinary texts; width, thresholds and scores by hits."""
    marked, common = _contrast(toxic[::2], ordinary[::2], width)
    if not marked:
        return 0.0, width, 0, 0, ()
    lengths = Lengths(Model(marked, common, width))
    pairs = [[np.array([lengths[w] for w in windows(t, width)], np.int64).reshape(-1, 2).T for t in texts[1::2] or texts] for texts in (toxic, ordinary)]

    def levels(side, near, gap):
        return [level((t <= near) & (o - t >= gap)) for t, o in side]

    best = None
    for near in range(4, 17):
        for gap in range(-2, 12):
            hit = [sum(n > 0 for n in levels(side, near, gap)) / len(side) for side in pairs]
            value = (hit[0] - 4 * hit[1], gap, -near)
            if best is None or value > best[0]:
                best = (value, near, gap)
    value, near, gap = best
    counts = [Counter(levels(side, near, gap)) for side in pairs]
    scores, least = [], 0.0
    for h in range(MOST + 1):  # at least so many hits, so that the score never falls with hits
        a, b = (sum(n for k, n in side.items() if (k >= h if h else k == 0)) for side in counts)
        least = max(least, (a + 0.1) / (a + b + 1.2)) if h else (a + 0.1) / (a + b + 1.2)
        scores.append(least)
    return value[0], width, near, gap, tuple(scores)


def sample(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[list[str], list[str]]:
    """Toxic and ordinary whole texts for learning: at most TOXIC and ORDINARY of them, by a hash of doc_id."""
    learn = learn & (F.length("text") <= LONGEST)
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    known = docs.filter(learn).select("doc_id").distinct().join(marked, "doc_id")
    order = F.xxhash64("doc_id")
    out = []
    for toxic, most in ((1, TOXIC), (0, ORDINARY)):
        # a bounded number of ids, so this broadcast is bounded too
        picked = known.filter(F.col("_toxic") == toxic).orderBy(order, "doc_id").limit(most).select("doc_id")
        texts = docs.filter(learn).join(F.broadcast(picked), "doc_id").select("doc_id", F.col("text").alias("t"))
        found = texts.filter("t is not null").orderBy("doc_id", "t").limit(most).collect()
        out.append([r.t for r in found])
    return out[0], out[1]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and n_hits of every row."""

    def make():
        hits = kept_tool(("toxicity", model), lambda: Hits(model))

        def many(doc_ids, held, texts):
            if not model.toxic:
                return doc_ids, held, [0.0] * len(texts), [0] * len(texts)
            found = [hits.of(t) for t in texts]
            return doc_ids, held, [model.scores[level(h)] for h in found], [int(h.sum()) for h in found]

        return many

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    found = per_batch(rows, "doc_id bigint, held_out boolean, score double, n_hits bigint", make, ["doc_id", "held_out", "text"])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows that are not held out, then score every row."""
    return score(docs, train(*sample(docs, labels, ~held_out(F.col("doc_id")))))
