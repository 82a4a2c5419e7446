"""Text: normal forms, hashes, statements, quotes, kinds of paths, token counts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it. \x0b is in Java's \s.
_SPACE = r"[\s\u0085\p{Z}]+"
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: First bytes of white space and controls that are neither a space nor a line break, in UTF-8.
_RARE = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3"
#: Code languages by file extension. Fixed values.
LANGUAGES: dict[str, str] = {
    "go": "go", "py": "py", "js": "jsts", "jsx": "jsts", "ts": "jsts", "tsx": "jsts", "mjs": "jsts", "cjs": "jsts",
    "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp",
    "java": "java", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin",
    "scala": "scala", "css": "css", "scss": "css", "html": "html", "htm": "html",
}
STATEMENT_CHARS = 300


def collapse(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def normalize_statement(text: Column) -> Column:
    return collapse(F.lower(text))


def statement_hash(text: Column) -> Column:
    return F.sha2(normalize_statement(text), 256)


def hash_normalized(text: Column) -> Column:
    """SHA-256 of the collapsed text, case kept; '' for blank text."""
    flat = collapse(text)
    return F.when(flat == "", "").otherwise(F.sha2(flat, 256))


def normalizer(text: str | None) -> Callable[[str], str]:
    """:func:`hash_normalized` for parts of ``text`` inside a task."""
    raw = (text or "").encode()
    if len(raw.translate(None, _RARE)) == len(raw):
        flat = _squeezed
    elif any(c in raw for c in b"\x1c\x1d\x1e\x1f"):  # what ``split`` takes for white space besides
        flat = lambda x: _SPACES.sub(" ", x).strip(" ")
    else:
        flat = lambda x: " ".join(x.split())
    return lambda x: hashlib.sha256(f.encode()).hexdigest() if (f := flat(x)) else ""


def _squeezed(text: str) -> str:
    """Every run of spaces and line breaks as one space, none at the ends."""
    text = text.replace("\n", " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip(" ")


def truncate(text: Column, n: int = STATEMENT_CHARS) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def lang_of(path: Column) -> Column:
    """Language key of a path by its extension, else ''."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.lit(""))


def kind_for_path(path: Column) -> Column:
    return F.when(lang_of(path) == "", "document").otherwise("code")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def first_sentence(text: Column) -> Column:
    """Up to the first full stop before a space, of the first line that is no heading and not blank."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    line = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    stop = F.instr(line, ". ")
    return F.when(stop > 0, F.substring(line, F.lit(1), stop)).otherwise(line)


def chunk_statement(heading: Column, path: Column, text: Column) -> Column:
    """Heading, or else the file's stem, and the chunk's first sentence."""
    lead = F.when(F.coalesce(heading, F.lit("")) == "", file_stem(path)).otherwise(heading)
    sentence = first_sentence(text)
    return truncate(F.when(sentence == "", lead).otherwise(F.concat(lead, F.lit(" — "), sentence)))


def line_breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def locate_quote(source: Column, quote: Column, base_line: Column) -> Column:
    """struct(line_start, line_end, text) of the first verbatim occurrence, or null."""
    at = F.when(F.coalesce(quote, F.lit("")) != "", F.instr(source, quote)).otherwise(0)
    base = F.when(F.coalesce(base_line, F.lit(1)) < 1, 1).otherwise(F.coalesce(base_line, F.lit(1)))
    start = base + line_breaks(F.substring(source, F.lit(1), at - 1))
    where = F.struct(
        start.cast("int").alias("line_start"),
        (start + line_breaks(quote)).cast("int").alias("line_end"),
        F.substring(source, at, F.length(quote)).alias("text"),
    )
    return F.when(at > 0, where)


def neutralize(text: Column, markers: tuple[str, ...]) -> Column:
    """Markers in content are broken by a zero-width space after their fourth character."""
    for m in markers:
        text = F.replace(text, F.lit(m), F.lit(m[:4] + "​" + m[4:]))
    return text


def token_count(text: Column) -> Column:
    """Words and single punctuation marks: the shape of a pre-tokenizer, without a vocabulary."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0))).cast("bigint")


def wordpiece_counter(vocab: frozenset[str], max_chars: int = 100, max_tokens: int = 512):
    """An Arrow UDF that counts greedy longest-match pieces under a vocabulary, ends included."""
    import re

    split = re.compile(r"\w+|[^\w\s]")

    def count(text: str | None) -> int:
        total = 2
        for word in split.findall((text or "").lower()):
            n, at = 0, 0
            while at < len(word) and len(word) <= max_chars:
                end = len(word)
                while end > at and ("##" if at else "") + word[at:end] not in vocab:
                    end -= 1
                if end == at:
                    break
                n, at = n + 1, end
            total += n if at == len(word) else 1
        return min(total, max_tokens)

    @F.pandas_udf("bigint")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(count)

    return pieces
