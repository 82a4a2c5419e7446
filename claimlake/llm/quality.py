"""Quality rules as a ledger of failure bits.

``ledger`` measures every row once and sets one bit for each rule that it fails.
Policies are versioned masks over these bits: ``apply_policy`` is a bitwise test,
and ``ablation`` tells from a count by bit pattern (2^rules rows at most) what each
rule costs and what would return without it. Neither reads a text again.

Defined results: a null or empty text has no words and fails FEW_WORDS; whole texts
are measured, however long; repeated rows get the same bits; extra columns are ignored;
empty tables give none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_batch

RUN = 5
SYMBOLS = "#*$%&|<>"

#: Measurements in order; all are counts.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_exclaims", "n_stutters")

#: Rule, and the condition under which a row fails it. Bit k belongs to the k-th rule; new rules are appended only.
RULES: tuple[tuple[str, str], ...] = (
    ("FEW_WORDS", "n_words < 10"),
    ("REPEATED_RUNS", "100 * n_repeat_words > 20 * n_words"),
    ("SYMBOLS", "100 * n_symbols > 25 * n_words"),
    ("SHOUTING", "2 * n_upper > n_upper + n_lower"),
    ("EXCLAIMING", "100 * n_exclaims > 30 * n_words"),
    ("STUTTERING", "100 * n_stutters > 30 * n_words"),
    ("LONG_WORDS", "word_chars > 30 * n_words"),
    ("SHORT_WORDS", "10 * word_chars < 15 * n_words"),
    ("DUPLICATE_LINES", "2 * n_dup_lines > n_lines"),
)
BASE = ("FEW_WORDS", "REPEATED_RUNS")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << k for k, (name, _) in enumerate(RULES) if name in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("base", BASE),
        Policy("v1", (*BASE, "SYMBOLS", "SHOUTING", "EXCLAIMING", "STUTTERING", "LONG_WORDS", "SHORT_WORDS")),
        Policy("strict", tuple(name for name, _ in RULES)),
    )
}


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """Words in runs of RUN words that occur twice or more."""
    n = len(ids) - RUN + 1
    if n < 2:
        return 0
    if distinct <= 4096:  # five ids fit one integer
        key = np.zeros(n, np.int64)
        for k in range(RUN):
            key = key << 12 | ids[k : n + k]
    else:
        pair = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1]
        four = np.unique(pair[:-2] << 32 | pair[2:], return_inverse=True)[1]
        key = four[:n] << 32 | ids[RUN - 1 :]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    again = np.zeros(n, bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    edge[:n] += again
    edge[RUN : n + RUN] -= again
    return int((np.cumsum(edge) > 0).sum())


_UPPER, _LOWER = (np.array([chr(b) in s for b in range(256)]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    own = raw.split()
    n = len(own)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0, 0, 0, text.count("!"), 0)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in own], np.int64)
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else [raw]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return (
        n,
        len(text) - spaces,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(ids, len(known)),
        len(lines),
        int(counts[_UPPER].sum()),
        int(counts[_LOWER].sum()),
        raw.count(b"!"),
        int((ids[1:] == ids[:-1]).sum()),
    )


def fail_bits() -> Column:
    """The bits of all rules over the MEASURES' columns."""
    bits = F.lit(0).cast("bigint")
    for k, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k)).otherwise(0).cast("bigint"))
    return bits


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, MEASURES and ``fail_bits`` of each row."""

    def make():
        none = ((),) * (1 + len(MEASURES))
        return lambda keys, texts: (keys, *zip(*map(measure, texts), strict=True)) if keys else none

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    return per_batch(docs, schema, make, [key, text]).withColumn("fail_bits", fail_bits())


def passes(policy: Policy, bits: Column | None = None) -> Column:
    return (F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and the policy's version."""
    return (
        rows.withColumn("base_failed", ~passes(POLICIES["base"]))
        .withColumn("kept", ~F.col("base_failed") & passes(policy))
        .withColumn("policy", F.lit(policy.version))
    )


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects."""
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    own = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    sums = [f(own, k, name) for k, (name, _) in enumerate(RULES) if name in policy.rules for f in (_failing, _only)]
    one = patterns.agg(*sums, F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.bit_or("fail_bits").alias("seen"))
    each = [
        F.struct(F.lit(name).alias("rule"), F.col(f"{name}_failing").alias("failing"), F.col(f"{name}_only").alias("only"))
        for name in policy.rules
    ]
    return one.select(F.explode(F.array(*each)).alias("r"), "rows").select("r.*", "rows")


def _failing(own: Column, k: int, name: str) -> Column:
    return F.coalesce(F.sum(F.when(own.bitwiseAND(F.lit(1 << k)) != 0, F.col("n"))), F.lit(0)).alias(f"{name}_failing")


def _only(own: Column, k: int, name: str) -> Column:
    return F.coalesce(F.sum(F.when(own == F.lit(1 << k), F.col("n"))), F.lit(0)).alias(f"{name}_only")


#: The measurements and failure bits in DuckDB SQL, by definition and not by the helper above.
_LEDGER_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, t, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower,
    length(t) - length(replace(t, '!', '')) AS n_exclaims
  FROM d),
p AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, w[i + 3] AS e, w[i + 4] AS f, n_words FROM m, unnest(range(1, n_words + 1)) u(i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c, e, f) AS times FROM p WHERE i + 4 <= n_words),
v AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM r WHERE times > 1) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) FILTER (WHERE a = b) AS n_stutters FROM p GROUP BY doc_id),
z AS (
  SELECT m.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_stutters, 0) AS n_stutters
  FROM m LEFT JOIN v USING (doc_id) LEFT JOIN s USING (doc_id)),
b AS (
  SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_upper > n_lower THEN 8 ELSE 0 END + CASE WHEN 100 * n_exclaims > 30 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_stutters > 30 * n_words THEN 32 ELSE 0 END
    + CASE WHEN word_chars > 30 * n_words THEN 64 ELSE 0 END + CASE WHEN 10 * word_chars < 15 * n_words THEN 128 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 256 ELSE 0 END AS bits
  FROM z)
"""
#: The query's columns.
SQL = _LEDGER_SQL + """SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, bits & 3 <> 0 AS base_failed, bits & 255 = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits, 'v1' AS policy
FROM b
"""
ABLATION_SQL = _LEDGER_SQL + """SELECT rule, count(*) FILTER (WHERE bits & bit <> 0) AS failing, count(*) FILTER (WHERE bits & 255 = bit) AS "only", count(*) AS rows
FROM b, (VALUES ('FEW_WORDS', 1), ('REPEATED_RUNS', 2), ('SYMBOLS', 4), ('SHOUTING', 8), ('EXCLAIMING', 16), ('STUTTERING', 32), ('LONG_WORDS', 64), ('SHORT_WORDS', 128)) r(rule, bit) GROUP BY rule
"""
