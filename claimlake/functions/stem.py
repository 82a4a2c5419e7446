"""English stems by suffix and measure: the number of vowel-consonant runs in what stands before the suffix.

After M. F. Porter, An algorithm for suffix stripping (1980).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes and what they become, by step; of several that fit, the longest counts. Fixed values.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
DOUBLE = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
SINGLE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)

_WORD = re.compile(r"[a-z]{3,}")


def shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or letter == "y" and out[-1:] == "c" else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, and the last isn't w, x or y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _mapped(word: str, table: dict[str, str], least: int) -> str:
    """The longest suffix of the table exchanged, where the rest measures more than ``least``."""
    suffix = _longest(word, table)
    if suffix is None or measure(word[: -len(suffix)]) <= least:
        return word
    return word[: -len(suffix)] + table[suffix]


def _past(word: str) -> str:
    suffix = _longest(word, ("eed", "ed", "ing"))
    if suffix == "eed":
        return word[:-1] if measure(word[:-3]) > 0 else word
    if suffix is None or "v" not in shape(rest := word[: -len(suffix)]):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _doubled(rest) and rest[-1] not in "lsz":
        return rest[:-1]
    return rest + "e" if measure(rest) == 1 and _short(rest) else rest


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word of three ASCII letters at least; any other word stays."""
    if not _WORD.fullmatch(word):
        return word
    word = _past(_mapped(word, PLURALS, -1))
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _mapped(_mapped(word, DOUBLE, 0), SINGLE, 0)
    suffix = _longest(word, LAST)
    if suffix is not None:
        cut = word[:-3] if suffix in ("sion", "tion") else word[: -len(suffix)]
        word = cut if measure(cut) > 1 else word
    if word.endswith("e"):
        m = measure(word[:-1])
        word = word[:-1] if m > 1 or m == 1 and not _short(word[:-1]) else word
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stemmed(term: Column) -> Column:
    """As :func:`stem`, over Arrow batches; for few words, such as those of requests."""

    @F.pandas_udf("string")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(stem, na_action="ignore")

    return each(term)
