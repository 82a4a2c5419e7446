"""Structural anchors: where in a document or source file evidence stands, and whether it still does."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lang_of, normalizer
from .chunk import _DOC, SECTION, headings, lines_of, outline, per_document, with_sections
from .scd import expire_claims

CONTEXT_LINES = 3

#: Words of the languages that may stand before a definition's keyword or its name.
MODIFIERS = (
    "abstract", "actual", "annotation", "async", "case", "companion", "convenience", "data", "declare", "default", "dyn", "dynamic", "expect", "explicit", "export",
    "extern", "external", "fileprivate", "final", "friend", "get", "implicit", "indirect", "infix", "inline", "inner", "internal", "lateinit", "lazy", "mut", "mutating",
    "native", "nonisolated", "open", "operator", "override", "partial", "private", "protected", "pub", "public", "readonly", "required", "sealed", "set", "static",
    "strictfp", "suspend", "synchronized", "tailrec", "template", "transient", "typedef", "unsafe", "value", "virtual", "volatile",
)
#: Keywords of each language that introduce a name.
DEFINERS = {
    "c": ("define", "enum", "struct", "union"),
    "cpp": ("class", "concept", "define", "enum", "namespace", "struct", "union", "using"),
    "csharp": ("class", "enum", "interface", "namespace", "record", "struct"),
    "css": (),
    "go": ("func", "type"),
    "java": ("class", "enum", "interface", "package", "record"),
    "jsts": ("class", "enum", "function", "interface", "module", "namespace", "type"),
    "kotlin": ("class", "enum", "fun", "interface", "object", "package", "typealias"),
    "php": ("class", "const", "enum", "function", "interface", "namespace", "trait"),
    "py": ("class", "def"),
    "ruby": ("class", "def", "module"),
    "rust": ("const", "enum", "fn", "impl", "macro_rules", "mod", "static", "struct", "trait", "type", "union"),
    "scala": ("class", "def", "object", "package", "trait", "val", "var"),
    "swift": ("actor", "class", "enum", "extension", "func", "protocol", "struct", "typealias"),
}
#: Languages whose functions need no keyword: a name, a parameter list and an opening brace in one line.
BRACED = ("c", "cpp", "csharp", "java", "jsts")
#: Words that open statements: neither such a function's name nor before it.
STATEMENTS = (
    "await", "case", "catch", "delete", "do", "else", "for", "foreach", "function", "goto", "if", "lock", "new", "return", "sizeof", "switch", "throw", "try", "using",
    "while", "with", "yield",
)

#: A parenthesis with what is in it; white space as Java's \s has it; lines up to this length are remembered.
_GROUP, _BLANK, _SHORT = "\x01", " \t\n\x0b\f\r", 200
_MODIFIERS, _STATEMENTS, _DEFINERS = frozenset(MODIFIERS), frozenset(STATEMENTS), {k: frozenset(v) for k, v in DEFINERS.items()}
_ANY_DEFINER, _RUN = frozenset().union(*DEFINERS.values()), re.compile(r"\w+")
#: A word and a name that nothing joins to what follows.
_PLAIN = re.compile(r"([a-z_]+) +([A-Za-z_][A-Za-z0-9_]*)(?=[ (;{]|:(?![:\"])|\Z)")
_INNER = ((re.compile(r"\([^()]*\)"), _GROUP, "(", 4), (re.compile(r"<[^<>]*>"), " ", "<", 3))
_ANNOTATIONS = re.compile(rf"(?:@[A-Za-z0-9_.]+{_GROUP}?[{_BLANK}]+)+")
_BEFORE_BRACE = re.compile(rf"([^;={{}}()]*?)[{_BLANK}]*{_GROUP}[^;={{}}()]*\{{")


@cache
def _grammar(plain: bool) -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    """A token, a word at the end, a function on the right of a sign, and a property's name before its accessors; ``plain`` for ASCII."""
    # letters are word characters that are no numbers; \d has decimal digits only
    numbers = "" if plain else "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
    head = "[A-Za-z_$~]" if plain else rf"(?:[$~]|(?![{numbers}])[^\W\d])"
    word, end = rf"{head}[\w$]*", r"\b" if plain else rf"(?:\b|(?=[{numbers}]))"
    return (
        re.compile(rf"{word}(?:(?:\.|::|\\){word})*[?]?|[^{_BLANK}]"), re.compile(rf"({word})[{_BLANK}]*[\x85\u2028\u2029]?\Z"),
        re.compile(rf"(?:async{end}[{_BLANK}]*)?(?:func(?:tion)?{end}|{_GROUP}[^=]*=>|{word}[{_BLANK}]*=>)"),
        re.compile(rf"[^;={{}}()]*[{_BLANK}]([A-Za-z0-9_]+)[{_BLANK}]*\{{[{_BLANK}]*(?:get|set|init){end}"),
    )


def _flat(line: str) -> str:
    """The line without string literals, type arguments and annotations, and with each parenthesis as one sign."""
    if '"' in line:
        line = re.sub('"[^"]*"', "", line)
    for inner, sign, opens, depth in _INNER:
        for _ in range(depth):
            if opens in line:
                line = inner.sub(sign, line)
    if line.startswith(f"pub{_GROUP}"):
        line = "pub " + line[4:]
    return _ANNOTATIONS.sub("", line, count=1) if line.startswith("@") else line


def _is_word(token: str | None) -> bool:
    return bool(token) and (token[0] in "_$~" or token[0].isalpha())


def _by_keyword(lang: str, line: str, words: list[str]) -> str | None:
    """modifiers* keyword+ name, where a name can be a word of the languages itself."""
    definers = _DEFINERS[lang]
    n = next((k for k, t in enumerate(words) if t not in _MODIFIERS and t not in definers), len(words))
    after, second = [*words[n : n + 2], None, None][:2]
    if not definers.isdisjoint(words[:n]):
        if _is_word(after):
            # impl Trait for Type
            if n and words[n - 1] == "impl" and "for" in words:
                return next(iter(words[words.index("for") + 1 :]), None)
            return after
        if after in ("*", "&", "!") and _is_word(second):
            return second
        if lang == "go" and after == _GROUP and _is_word(second):
            # func (r *Receiver[T]) name
            held = re.search(r"\(([^()]*)\)", line)
            owner = _grammar(line.isascii())[1].search(re.sub("\\[[^\n\r\x85\u2028\u2029]*", "", held[1])) if held else None
            return f"{owner[1]}.{second}" if owner else second
        if n > 1 and not definers.isdisjoint(words[: n - 1]):
            return words[n - 1]
    return None


def _by_brace(lang: str, flat: str, level: int) -> str | None:
    """type* name(parameters) ... {, or a property with its accessors."""
    before = _BEFORE_BRACE.match(flat)
    words = _grammar(flat.isascii())[0].findall(before[1]) if before else []
    if words and _is_word(words[-1]) and "." not in words[-1] and words[-1] != "synchronized" and _STATEMENTS.isdisjoint(words):
        *lead, name = words
        if level > 0 and all(t == "*" or t in _MODIFIERS for t in lead) if lang == "jsts" else _is_word(words[0]) and (lead or "::" in name):
            return name
    return found[1] if lang == "csharp" and (found := _grammar(flat.isascii())[3].match(flat)) else None


def _by_binding(flat: str) -> str | None:
    """A variable that is bound to a function."""
    token, _, bound, _ = _grammar(flat.isascii())
    left, _, right = flat.partition("=")
    if bound.match(right.strip(" ")):
        binder = [t for t in token.findall(left) if t not in _MODIFIERS]
        if len(binder) > 1 and binder[0] in ("const", "let", "var"):
            return binder[1]
    return None


def definition(lang: str, line: str, level: int) -> str | None:
    """Name of the definition that a trimmed line opens, or None, in any of ``DEFINERS``."""
    if lang == "css":
        body = line[:-1].rstrip(" ")
        return body if line.endswith("{") and not re.search("[{};]", body) else None
    # most lines have neither a keyword nor a brace nor a function's sign
    if "{" not in line and "=>" not in line and _ANY_DEFINER.isdisjoint(_RUN.findall(line)):
        return None
    # the most frequent form by itself
    plain = _PLAIN.match(line) if lang not in ("c", "cpp") else None
    if plain and plain[1] != "impl" and plain[1] in _DEFINERS[lang] and plain[2] not in _DEFINERS[lang] and plain[2] not in _MODIFIERS:
        return plain[2]
    flat = _flat(line[1:].lstrip(_BLANK) if lang in ("c", "cpp") and line.startswith("#") else line)
    name = _by_brace(lang, flat, level) if lang in ("c", "cpp") else None
    # `struct s f(void) {` is a function, `class C extends f(D) {` a class
    name = _by_keyword(lang, line, _grammar(flat.isascii())[0].findall(flat)) if name is None else name
    name = _by_binding(flat) if name is None and lang in ("jsts", "go") else name
    return _by_brace(lang, flat, level) if name is None and lang in ("csharp", "java", "jsts") else name


def _mark(lang: str, line: str) -> tuple[int, str] | None:
    """Level and name of the definition in a line; the level is the indentation (a tab is four)."""
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    level = len(lead) + 3 * lead.count("\t")
    title = (definition(lang, line.strip(_BLANK), level) or "").strip(" ")
    return (level, title) if title else None


#: Lines are often alike.
_known_mark = lru_cache(1 << 17)(_mark)


def code_marks(lang: str, lines: list[str]) -> list[tuple[int, int, str]]:
    """Marks (line, level, title) of the definitions among a file's lines."""
    if lang not in DEFINERS:
        return []
    return [(n, *m) for n, line in enumerate(lines, 1) if (m := (_known_mark if len(line) <= _SHORT else _mark)(lang, line))]


def _marks(lines: list[str], lang: str) -> Iterable[tuple[int, int, str | None]]:
    """Definitions of code, headings of a document."""
    return code_marks(lang, lines) if lang else headings(lines)


def _with_lang(files: DataFrame) -> DataFrame:
    return files.withColumn("_lang", lang_of(F.col("path")))


def sections(files: DataFrame) -> DataFrame:
    """Sections by kind: headings of documents, definitions of code."""
    return with_sections(_with_lang(files), SECTION, _marks, ("_lang",)).select(*_DOC, F.inline("sections"))


def code_sections(files: DataFrame) -> DataFrame:
    """As ``heading_sections``, over definitions; a line of any length is looked at whole."""
    return sections(files.filter(lang_of(F.col("path")) != ""))


def section_hashes(files: DataFrame) -> DataFrame:
    """Sections of all files with ``node_hash``, each text cut up once."""
    return with_sections(_with_lang(files), (*SECTION, "node_hash"), _marks, ("_lang",)).select(*_DOC, F.inline("sections"))


def _by_file(spans: DataFrame) -> DataFrame:
    """The spans of a file as ``_rows``, so that the file meets them once."""
    return spans.groupBy(*_DOC).agg(F.collect_list(F.struct(*spans.columns)).alias("_rows"))


def _of_rows(placed: DataFrame) -> DataFrame:
    """``_rows`` and what was found for each, as rows."""
    return placed.select(F.inline(F.arrays_zip("_rows", "_places"))).select("_rows.*", "_places.*")


def place_spans(files: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (repo, path, line_start, line_end, ...) with symbol_path and node_hash: the section that holds the first line, and its text.

    Spans of files that are not there are left out. Texts are cut up where they are
    read: only sections, without their texts, meet the spans.
    """
    names = ["symbol_path", "node_hash"]

    @F.arrow_udf(f"array<struct<{','.join(f'{n}:string' for n in names)}>>")
    def held(firsts: pa.Array, begins: pa.Array, paths: pa.Array, hashes: pa.Array) -> pa.Array:
        # sections don't overlap: the last one that begins at or before a line holds it; one search for all files of a batch
        starts = np.concatenate(([-1], _places(begins)))
        wanted = _places(firsts)
        k = np.searchsorted(starts, wanted, side="right") - 1
        at = pa.array(k - 1, mask=starts[k] >> 32 != wanted >> 32)
        found = [pc.fill_null(x.flatten().take(at), "") for x in (paths, hashes)]
        return pa.ListArray.from_arrays(firsts.offsets, pa.StructArray.from_arrays(found, names))

    met = _by_file(spans).join(with_sections(_with_lang(files), ("line_start", *names), _marks, ("_lang",)), _DOC)
    firsts = F.col("_rows.line_start").cast("array<bigint>")
    return _of_rows(met.select("_rows", held(firsts, *[F.col(f"sections.{n}") for n in ("line_start", *names)]).alias("_places")))


def _places(lines: pa.ListArray) -> np.ndarray:
    """Each line as one number with the number of its list; null is line 0."""
    flat = pc.fill_null(lines.flatten().cast(pa.int64()), 0).to_numpy()
    return (pc.list_parent_indices(lines).to_numpy() << 32) + flat.clip(0, 2**31)


def compute_anchor(files: DataFrame, spans: DataFrame) -> DataFrame:
    """As ``place_spans``, with window_hash and byte_hash: of the span with three lines around it, and of the span itself."""

    def of(text: str | None, lang: str, firsts: list[int | None], lasts: list[int | None]) -> list[tuple]:
        lines, norm = lines_of(text), normalizer(text)
        found = outline(len(lines), _marks(lines, lang))
        begins, hashes = [s[0] for s in found], {}

        def held(first: int | None) -> tuple[str, str]:
            # as in place_spans
            k = bisect_right(begins, first) - 1 if first is not None else -1
            if k < 0:
                return "", ""
            if k not in hashes:
                hashes[k] = norm("\n".join(lines[found[k][0] - 1 : found[k][1]]))
            return found[k][4], hashes[k]

        def span(first: int | None, last: int | None, more: int) -> str:
            upto = len(lines) if last is None else max(last + more, 0)
            return "\n".join(lines[(1 if first is None else max(first - more, 1)) - 1 : upto])

        own = [span(first, last, 0) for first, last in zip(firsts, lasts, strict=True)]
        window = [span(first, last, CONTEXT_LINES) for first, last in zip(firsts, lasts, strict=True)]
        return [(*held(first), norm(w), hashlib.sha256(o.encode()).hexdigest()) for first, w, o in zip(firsts, window, own, strict=True)]

    # a file's text meets its spans once, and is gone through once
    lines = {"_firsts": "line_start", "_lasts": "line_end"}
    met = _with_lang(_by_file(spans).join(files.select(*_DOC, "text"), _DOC)).withColumns({k: F.col(f"_rows.{c}").cast("array<bigint>") for k, c in lines.items()})
    names = ["symbol_path", "node_hash", "window_hash", "byte_hash"]
    return _of_rows(per_document(met, ["_rows"], ["_lang", *lines], of, dict.fromkeys(names, pa.string()), "_places"))


def resolve_anchor(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """``anchors`` (repo, path, symbol_path, node_hash, ...) with verdict, expires and detail.

    Without path or hash: unanchored. No section of that path, or one with another
    text: semantic-change. Two or more: ambiguous. A file that is not there: missing-file.
    """
    found = section_hashes(files).groupBy(*_DOC, "symbol_path").agg(F.count("*").alias("_n"), F.max("node_hash").alias("_hash"))
    there = files.select(*_DOC).distinct().withColumn("_there", F.lit(True))
    joined = anchors.join(there, _DOC, "left").join(found, [*_DOC, "symbol_path"], "left")
    n = F.coalesce("_n", F.lit(0))
    bare = (F.coalesce("symbol_path", F.lit("")) == "") | (F.coalesce("node_hash", F.lit("")) == "")
    verdict = (
        F.when(F.col("_there").isNull(), "missing-file").when(bare, "unanchored").when(n == 0, "semantic-change").when(n > 1, "ambiguous")
        .when(F.col("_hash") == F.col("node_hash"), "valid").otherwise("semantic-change")
    )
    detail = (
        F.when(F.col("verdict") == "ambiguous", F.format_string("%d sections are named %s", n, F.col("symbol_path")))
        .when((F.col("verdict") == "semantic-change") & (n == 0), F.format_string("no section is named %s", F.col("symbol_path")))
        .when(F.col("verdict") == "semantic-change", F.format_string("the text of %s changed", F.col("symbol_path")))
    )
    out = joined.withColumn("verdict", verdict)
    return out.withColumn("expires", F.col("verdict").isin("semantic-change", "ambiguous")).withColumn("detail", detail).select(*anchors.columns, "verdict", "expires", "detail")


def reanchor(claims: DataFrame, anchors: DataFrame, files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``anchors`` (claim_id, repo, path, ...): (claims with stale ones expired, verdicts, report by repo).

    One stale piece of evidence expires its claim; missing files expire nothing.
    """
    verdicts = resolve_anchor(anchors, files)
    stale = verdicts.filter("expires").select(F.col("claim_id").alias("id"))
    report = verdicts.groupBy("repo").agg(
        F.count_if(F.col("verdict") != "missing-file").alias("checked"), F.count_if(F.col("verdict") == "valid").alias("valid"),
        F.count_if("expires").alias("expired"), F.count_if(F.col("verdict") == "unanchored").alias("unanchored"),
        F.count_if(F.col("verdict") == "missing-file").alias("missing_file"),
    )
    return expire_claims(claims, stale, "stale_anchor", now), verdicts, report
