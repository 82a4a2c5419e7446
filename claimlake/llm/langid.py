"""Language identification by cross-parsing entropy.

A suffix automaton is built from a bounded sample of labelled text of each language.
A document is parsed greedily against each automaton: a phrase is the longest match
from where the last one ended. The phrases, times the logarithm of the training
length, per symbol estimate the cross entropy; the least one wins. The automata are
dense transition tables, and all blocks of a batch of documents step through them
together, so a step is a few array operations.

Defined results: ``und`` and score 0 for a null text, a text without a letter, or if
nothing could be learned; ties go to the smaller language name; whole texts are
parsed, in blocks of ``BLOCK`` symbols, at whose ends a phrase ends too; repeated
rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, kept_tool, per_batch

#: Slices of all languages together, of each language at most and at least, and their characters: the bound of what is learned from.
ALL_SLICES, SLICES, FEWEST, SLICE_CHARS = 1024, 160, 8, 240
#: Letters with a symbol of their own, the most frequent of the sample, and the symbols that all others share by their code point.
LETTERS, SHARED = 120, 40
BLOCK = 512

_SEPARATOR, _FIRST = 0, 1


def sample(docs: DataFrame, learn: Column, label: str = "lang", text: str = "text", key: str = "doc_id") -> dict[str, list[str]]:
    """Slices of text for each label, from at most SLICES rows each, chosen by a hash of key and text.

    Every label is learned; many labels share ALL_SLICES, but FEWEST are taken of each.
    Equal rows are one.
    """
    rows = docs.filter(learn & F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("_l"), F.col(key).alias("_k"), F.col(text).alias("_t"))
    names = rows.select("_l").distinct().count()
    most = max(FEWEST, min(SLICES, ALL_SLICES // max(1, names)))
    own = F.xxhash64("_k", "_t")
    ranked = rows.select("_l", own.alias("_h")).distinct()
    picked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("_l").orderBy("_h"))).filter(F.col("_n") <= most).select("_l", "_h")
    start = 1 + F.pmod(F.xxhash64("_k", F.lit(7)), F.greatest(F.length("_t") - SLICE_CHARS, F.lit(1)))
    pieces = rows.withColumn("_h", own).join(F.broadcast(picked), ["_l", "_h"]).select("_l", "_h", F.substring(F.col("_t"), start.cast("int"), F.lit(SLICE_CHARS)).alias("_p"))
    out: dict[str, list[str]] = {}
    for name, _, piece in sorted(map(tuple, pieces.distinct().collect())):
        out.setdefault(name, []).append(piece)
    return out


def automaton(symbols: list[int], size: int) -> np.ndarray:
    """Suffix automaton as a dense table of next states; -1 where there is none."""
    table, link, length = [[-1] * size], [-1], [0]
    last = 0
    for s in symbols:
        new = len(table)
        table.append([-1] * size)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and table[p][s] < 0:
            table[p][s] = new
            p = link[p]
        if p >= 0:
            q = table[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(table)
                table.append(table[q][:])
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and table[p][s] == q:
                    table[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return np.array(table, np.int64)


class Model:
    """Automata of all languages over one alphabet."""

    def __init__(self, training: tuple[tuple[str, tuple[str, ...]], ...]):
        self.names = [name for name, _ in training]
        seen = Counter(c for _, pieces in training for x in pieces for c in x.lower() if c.isalpha())
        letters = sorted(seen, key=lambda c: (-seen[c], c))[:LETTERS]
        # letters beyond the most frequent ones still differ from one another, by their place in a script
        self.symbol = (np.arange(0x110000) % SHARED + _FIRST).astype(np.int32)
        self.letter = np.array([chr(i).isalpha() for i in range(0x110000)])
        self.symbol[~self.letter] = _SEPARATOR
        for k, c in enumerate(letters):
            self.symbol[ord(c)] = k + _FIRST + SHARED
        self.size = len(letters) + SHARED + _FIRST + 1
        self.pad = self.size - 1
        self.tables, self.weight = [], []
        for _, pieces in training:
            symbols = self.symbols("\n".join(pieces).lower()).tolist()
            # the last row is the state after a symbol that the training text lacks: a phrase of its own
            nexts = np.vstack([automaton(symbols, self.size), np.full((1, self.size), -1)])
            # one look-up does a step: doubled next row, plus 1 where a phrase has ended before this symbol
            fail = nexts < 0
            fail[0] = False  # no phrase is open in the first state
            root = np.where(nexts[0] < 0, len(nexts) - 1, nexts[0])
            nexts[0] = root
            step = np.where(fail, root[None, :], nexts) * self.size * 2 + fail
            step[:, self.pad] = np.arange(len(nexts)) * self.size * 2
            self.tables.append(step.astype(np.int32).ravel())
            self.weight.append(math.log2(max(2, len(symbols))))

    def symbols(self, lowered: str) -> np.ndarray:
        """Symbols of a lower-cased text, runs of separators as one."""
        found = self.symbol[np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != _SEPARATOR) | (found[:-1] != _SEPARATOR)
        return found[keep]

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits a symbol of each text (rows) under each language (columns)."""
        parts = [self.symbols(t.lower()) for t in texts]
        blocks = [-(-len(p) // BLOCK) for p in parts]
        starts = np.concatenate([[0], np.cumsum(blocks)])
        flat = np.full(int(starts[-1]) * BLOCK, self.pad, np.int32)
        for p, at in zip(parts, starts[:-1] * BLOCK, strict=True):
            flat[at : at + len(p)] = p
        columns = np.ascontiguousarray(flat.reshape(-1, BLOCK).T)
        out = np.zeros((len(texts), len(self.names)))
        sizes = np.array([max(1, len(p)) for p in parts])
        owner = np.repeat(np.arange(len(texts)), blocks)
        for k, table in enumerate(self.tables):
            state = np.zeros(columns.shape[1], np.int32)
            ended = np.zeros(columns.shape[1], np.int32)
            for column in columns:
                state += column
                found = table[state]
                ended += found & 1
                np.right_shift(found, 1, out=state)
            phrases = np.bincount(owner, ended + 1, len(texts))
            out[:, k] = phrases * self.weight[k] / sizes
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        judged = [k for k, t in enumerate(texts) if t and self.names and any(map(str.isalpha, t))]
        if judged:
            bits = self.entropies([texts[k] for k in judged])
            order = np.argsort(bits, axis=1, kind="stable")
            for k, row, o in zip(judged, bits, order, strict=True):
                names[k] = self.names[o[0]]
                scores[k] = float(row[o[1]] / (row[o[0]] + row[o[1]])) if len(o) > 1 else 1.0
        return names, scores


def model(training: tuple[tuple[str, tuple[str, ...]], ...]) -> Model:
    return kept_tool(("langid", training), lambda: Model(training))


def identify(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from rows where ``learn`` holds."""
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    training = tuple((name, tuple(pieces)) for name, pieces in sorted(sample(docs, learn).items()))

    def make():
        judge = model(training)
        return lambda doc_id, held, text: (doc_id, held, *judge.predict(text))

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double"
    return per_batch(rows, schema, make, ["doc_id", "held_out", "text"], rows=512)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose text has a language; all columns stay. The text takes part once."""
    training = tuple((name, tuple(pieces)) for name, pieces in sorted(sample(docs, ~held_out(F.col("doc_id"))).items()))
    columns = docs.columns
    at = columns.index("text")

    def make():
        judge = model(training)

        def many(*values):
            kept = [name != "und" for name in judge.predict(values[at])[0]]
            return tuple([v for v, k in zip(column, kept, strict=True) if k] for column in values)

        return many

    return per_batch(docs, docs.schema, make, columns, rows=512)
