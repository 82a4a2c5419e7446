"""The registered queries over documents and anchors, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stem, text
from .operators import anchor, chunk, recall, retrieval
from .plans import fixtures as fx
from .plans.sql import SPACE
from .registry import query
from .sources import docs
from .sources.scratch import scratch_dir

_MARKDOWN = """md AS (SELECT source AS repo, 'docs/' || doc_id || '.md' AS path, doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE
  WHEN (i - 1) % 5 = 0 THEN '# Part ' || (i - 1) || chr(10) || x WHEN (i - 1) % 5 = 2 THEN '## Sub ' || (i - 1) || chr(10) || x
  WHEN (i - 1) % 7 = 3 THEN '```' || chr(10) || '# no heading' || chr(10) || x || chr(10) || '```' ELSE x END), chr(10)) AS text FROM documents WHERE text IS NOT NULL)"""
_WORDS = "list_filter(regexp_split_to_array(text, '[^a-zA-Z]+'), lambda x: x <> '')"


def _lines_sql(n: str, files: str) -> str:
    """CTEs: {n}_f, the lines of (repo, path, text) with their fences, and {n}_h, the headings outside them."""
    return f"""{n}_l AS (SELECT repo, path, ls, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT repo, path,
    CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS ls FROM {files})),
  {n}_e AS (SELECT repo, path, line, ls[line] AS t, len(ls) AS n, starts_with(trim(ls[line]), '```') AS fence FROM {n}_l),
  {n}_f AS (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path ORDER BY line) % 2 = 1 AS open FROM {n}_e),
  {n}_h AS (SELECT repo, path, line, length(regexp_extract(t, '^#+')) AS level, trim(regexp_replace(t, '^#+', '')) AS title,
    coalesce(lead(line) OVER (PARTITION BY repo, path ORDER BY line) - 1, n) AS line_end FROM {n}_f WHERE starts_with(t, '#') AND NOT fence AND NOT open)"""


def _paths_sql(n: str) -> str:
    """CTEs: {n}_p, the headings with the path through the nearest earlier ones of less depth."""
    return f"""{n}_q AS (SELECT h.repo, h.path, h.line, h.level, h.title, h.line_end, max(g.line) AS parent FROM {n}_h h LEFT JOIN {n}_h g
    ON g.repo = h.repo AND g.path = h.path AND g.line < h.line AND g.level < h.level GROUP BY ALL),
  {n}_p AS (SELECT *, title AS symbol_path FROM {n}_q WHERE parent IS NULL UNION ALL
    SELECT q.*, p.symbol_path || ' > ' || q.title FROM {n}_q q JOIN {n}_p p ON q.repo = p.repo AND q.path = p.path AND q.parent = p.line)"""


def _hashed_sql(n: str) -> str:
    """CTE: {n}_s, the sections with the hash of their text."""
    return f"""{n}_s AS (SELECT repo, path, line, line_end, symbol_path, CASE WHEN x = '' THEN '' ELSE sha256(x) END AS node_hash FROM (
    SELECT p.repo, p.path, p.line, p.line_end, p.symbol_path, trim(regexp_replace(string_agg(f.t, chr(10) ORDER BY f.line), '{SPACE}', ' ', 'g')) AS x
    FROM {n}_p p JOIN {n}_f f ON f.repo = p.repo AND f.path = p.path AND f.line BETWEEN p.line AND p.line_end GROUP BY ALL))"""


@query(
    """WITH l AS (SELECT doc_id, source, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS ls FROM documents WHERE text <> ''),
  e AS (SELECT doc_id, source, i AS line, ls[i] AS t FROM l, unnest(range(1, len(ls) + 1)) u(i)),
  c AS (SELECT doc_id, source, (line - 1) // 40 AS part, min(line) AS line_start, max(line) AS line_end, regexp_replace(string_agg(t, chr(10) ORDER BY line), '^[\\s\\x0B\\x{85}\\pZ]+|[\\s\\x0B\\x{85}\\pZ]+$', '', 'g') AS text FROM e GROUP BY ALL)
  SELECT source AS repo, 'docs/' || doc_id || '.md' AS path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS ordinal,
  CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, sha256(text) AS content_sha256 FROM c WHERE text <> ''"""
)
def chunk_documents(spark, sf):
    """Whole documents in chunks of at most forty lines."""
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("repo"), F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), "text")
    return chunk.chunk_documents(d).select("repo", "path", "ordinal", "line_start", "line_end", "content_sha256")


@query(
    "WITH RECURSIVE "
    + ",\n".join((
        f"""md AS (SELECT source AS repo, 'docs/' || doc_id || '.md' AS path, array_to_string(list_transform({_WORDS}, lambda x, i: CASE WHEN (i - 1) % 97 = 0 THEN '# Part ' || (i - 1) || chr(10) || x
  WHEN (i - 1) % 61 = 7 THEN '```' || chr(10) || x ELSE x END), chr(10)) AS text FROM documents WHERE text IS NOT NULL)""",
        _lines_sql("m", "md"),
        """x AS (SELECT *, starts_with(t, '#') AND NOT fence AND NOT open AS is_heading FROM m_f),
  y AS (SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER w AS section,
    last_value(CASE WHEN is_heading THEN nullif(trim(regexp_replace(t, '^#+', '')), '') END IGNORE NULLS) OVER w AS heading FROM x WINDOW w AS (PARTITION BY repo, path ORDER BY line)),
  s AS (SELECT *, row_number() OVER (PARTITION BY repo, path, section ORDER BY line) AS j FROM y),
  r AS (SELECT repo, path, section, j, line, t, heading, 0 AS part, 1 AS n, 0 AS cut FROM s WHERE j = 1
    UNION ALL SELECT s.repo, s.path, s.section, s.j, s.line, s.t, s.heading, r.cut, CASE WHEN r.n + 1 >= 40 AND NOT s.open THEN 0 ELSE r.n + 1 END, CASE WHEN r.n + 1 >= 40 AND NOT s.open THEN r.cut + 1 ELSE r.cut END
    FROM r JOIN s ON s.repo = r.repo AND s.path = r.path AND s.section = r.section AND s.j = r.j + 1),
  c AS (SELECT repo, path, coalesce(max_by(heading, line), '') AS heading, min(line) AS line_start, max(line) AS line_end,
    regexp_replace(string_agg(t, chr(10) ORDER BY line), '^[\\s]+|[\\s]+$', '', 'g') AS text FROM r GROUP BY repo, path, section, part),
  d AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(v)), lambda v: v <> '' AND NOT starts_with(v, '#'))[1] AS sentence,
    CASE WHEN heading = '' THEN regexp_extract(path, '([0-9]+)', 1) ELSE heading END AS lead FROM c WHERE text <> '')""",
    ))
    + """ SELECT repo, path, CAST(row_number() OVER (PARTITION BY repo, path ORDER BY line_start) - 1 AS INTEGER) AS ordinal, heading, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end,
  CASE WHEN length(st) > 300 THEN st[:299] || '…' ELSE st END AS statement FROM (SELECT *, lead || coalesce(' — ' || sentence, '') AS st FROM d)"""
)
def chunk_markdown(spark, sf):
    """Chunks at headings and of forty lines, outside fences, of the documents' words with headings and fences between."""
    return chunk.chunk_documents(fx.fenced(spark, sf)).select("repo", "path", "ordinal", "heading", "line_start", "line_end", "statement")


@query(
    "WITH RECURSIVE " + ",\n".join((_MARKDOWN, _lines_sql("m", "md"), _paths_sql("m")))
    + " SELECT repo, path, CAST(line AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, CAST(level AS INTEGER) AS level, title, symbol_path FROM m_p"
)
def heading_sections(spark, sf):
    """Headings with their paths and extents."""
    return chunk.heading_sections(fx.markdown(spark, sf))


@query(
    f"""WITH d AS (SELECT source AS repo, doc_id || '.py' AS path, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
  e AS (SELECT repo, path, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM d)
  SELECT repo, path, CAST(i AS INTEGER) AS line_start, CAST(CASE WHEN i % 4 = 1 AND i < n THEN i WHEN i % 4 = 1 THEN n ELSE least(i + 2, n) END AS INTEGER) AS line_end,
  CASE WHEN i % 4 = 1 THEN 0 ELSE 4 END AS level, 'w' || w[i] AS title, CASE WHEN i % 4 = 1 THEN 'w' || w[i] ELSE 'w' || w[i - 1] || ' > w' || w[i] END AS symbol_path FROM e WHERE i % 4 IN (1, 2)"""
)
def code_sections(spark, sf):
    """Definitions with their paths, in code made from the documents' words."""
    d = fx.table(spark, sf, "documents").filter(F.col("text").isNotNull())
    w = F.filter(F.split("text", r"[^a-zA-Z]+"), lambda x: x != "")
    lines = F.transform(w, lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("class w"), x, F.lit(":"))).when(i % 4 == 1, F.concat(F.lit("    def w"), x, F.lit("(self):"))).otherwise(F.concat(F.lit("        return w"), x)))
    files = d.select(F.col("source").alias("repo"), F.concat("doc_id", F.lit(".py")).alias("path"), F.array_join(lines, "\n").alias("text"))
    return anchor.code_sections(files)


def _anchors(spark: SparkSession, sf: str, of: Callable[[DataFrame, DataFrame], DataFrame] = anchor.place_spans) -> tuple[DataFrame, DataFrame]:
    """Anchors of the Markdown documents' sections, and the files with every third one edited and every fifth gone."""
    files = fx.markdown(spark, sf)
    spans = chunk.heading_sections(files, ("line_start",)).withColumn("line_end", F.col("line_start"))
    anchors = of(files, spans)
    number = F.regexp_extract("path", r"(\d+)", 1).cast("bigint")
    later = files.filter(number % 5 != 0).withColumn("text", F.when(number % 3 == 0, F.replace("text", F.lit("e"), F.lit("ee"))).otherwise(F.replace("text", F.lit("\n"), F.lit(" \n"))))
    return anchors, later


_VERDICTS = "WITH RECURSIVE " + ",\n".join((
    _MARKDOWN, _lines_sql("m", "md"), _paths_sql("m"), _hashed_sql("m"),
    """later AS (SELECT repo, path, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'ee') ELSE replace(text, chr(10), ' ' || chr(10)) END AS text FROM md WHERE doc_id % 5 <> 0)""",
    _lines_sql("z", "later"), _paths_sql("z"), _hashed_sql("z"),
    """found AS (SELECT repo, path, symbol_path, count(*) AS n, max(node_hash) AS hash FROM z_s GROUP BY ALL),
  verdicts AS (SELECT a.repo, a.path, a.line AS line_start, a.symbol_path, CASE WHEN l.path IS NULL THEN 'missing-file' WHEN a.symbol_path = '' OR a.node_hash = '' THEN 'unanchored' WHEN f.n IS NULL THEN 'semantic-change'
    WHEN f.n > 1 THEN 'ambiguous' WHEN f.hash = a.node_hash THEN 'valid' ELSE 'semantic-change' END AS verdict
    FROM m_s a LEFT JOIN later l ON l.repo = a.repo AND l.path = a.path LEFT JOIN found f ON f.repo = a.repo AND f.path = a.path AND f.symbol_path = a.symbol_path)""",
))


@query(_VERDICTS + " SELECT repo, path, CAST(line_start AS INTEGER) AS line_start, symbol_path, verdict, verdict IN ('semantic-change', 'ambiguous') AS expires FROM verdicts")
def resolve_anchor(spark, sf):
    """Whether each anchor still holds."""
    anchors, later = _anchors(spark, sf)
    return anchor.resolve_anchor(anchors, later).select("repo", "path", "line_start", "symbol_path", "verdict", "expires")


@query(
    _VERDICTS
    + """ SELECT repo, count(*) FILTER (WHERE verdict <> 'missing-file') AS checked, count(*) FILTER (WHERE verdict = 'valid') AS valid, count(*) FILTER (WHERE verdict IN ('semantic-change', 'ambiguous')) AS expired,
  count(*) FILTER (WHERE verdict = 'unanchored') AS unanchored, count(*) FILTER (WHERE verdict = 'missing-file') AS missing_file FROM verdicts GROUP BY repo"""
)
def reanchor_report(spark, sf):
    """Verdicts by repository."""
    anchors, later = _anchors(spark, sf)
    number = F.regexp_extract("path", r"(\d+)", 1)
    return anchor.reanchor(fx.claims(spark, sf), anchors.withColumn("claim_id", number), later, fx.now())[2]


@query(_VERDICTS + " SELECT regexp_extract(path, '([0-9]+)', 1) AS id, 'stale_anchor' AS reason FROM verdicts JOIN documents ON CAST(doc_id AS VARCHAR) = regexp_extract(path, '([0-9]+)', 1) WHERE verdict IN ('semantic-change', 'ambiguous') AND doc_id % 11 <> 0 GROUP BY ALL")
def stale_claims(spark, sf):
    """Live claims that a stale anchor expires."""
    anchors, later = _anchors(spark, sf)
    claims = anchor.reanchor(fx.claims(spark, sf), anchors.withColumn("claim_id", F.regexp_extract("path", r"(\d+)", 1)), later, fx.now())[0]
    return claims.filter("supersede_reason = 'stale_anchor'").select("id", F.col("supersede_reason").alias("reason"))


@query(
    "WITH RECURSIVE " + ",\n".join((_MARKDOWN, _lines_sql("m", "md"), _paths_sql("m")))
    + f""", spans AS (SELECT p.repo, p.path, p.line, string_agg(f.t, chr(10) ORDER BY f.line) AS around, any_value(CASE WHEN f.line = p.line THEN f.t END) AS own
    FROM m_p p JOIN m_f f ON f.repo = p.repo AND f.path = p.path AND f.line BETWEEN p.line - 3 AND p.line + 3 GROUP BY ALL),
  norms AS (SELECT *, trim(regexp_replace(around, '{SPACE}', ' ', 'g')) AS x FROM spans)
  SELECT repo, path, CAST(line AS INTEGER) AS line_start, CASE WHEN x = '' THEN '' ELSE sha256(x) END AS window_hash, sha256(own) AS byte_hash FROM norms"""
)
def anchor_hashes(spark, sf):
    """The hashes of a span with its surroundings and of the span itself."""
    return _anchors(spark, sf, anchor.compute_anchor)[0].select("repo", "path", "line_start", "window_hash", "byte_hash")


@query(_VERDICTS.replace("a.node_hash = '' THEN 'unanchored'", "a.node_hash = '' OR a.line % 2 = 0 THEN 'unanchored'") + " SELECT repo, path, verdict, count(*) AS n FROM verdicts GROUP BY ALL")
def bare_anchors(spark, sf):
    """Every other anchor has lost its hash, and is unanchored while its file is there."""
    anchors, later = _anchors(spark, sf)
    bare = anchors.withColumn("node_hash", F.when(F.col("line_start") % 2 == 0, "").otherwise(F.col("node_hash")))
    return anchor.resolve_anchor(bare, later).groupBy("repo", "path", "verdict").agg(F.count("*").alias("n"))


_PLANTED = f"replace(replace(text, 'an', '{recall.DATA_END}'), 'be', 'x{recall.DATA_BEGIN}{recall.DATA_END}')"


@query(
    f"SELECT doc_id, sha256(replace(replace({_PLANTED}, '{recall.DATA_END}', '{recall.DATA_END[:4]}' || chr(8203) || '{recall.DATA_END[4:]}'), '{recall.DATA_BEGIN}', '{recall.DATA_BEGIN[:4]}' || chr(8203) || '{recall.DATA_BEGIN[4:]}')) AS safe, "
    f"contains({_PLANTED}, '{recall.DATA_END}') AS planted FROM documents"
)
def neutralize_markers(spark, sf):
    """Markers of the fence, planted in the documents' texts, are broken."""
    planted = F.expr(_PLANTED)
    safe = text.neutralize(planted, (recall.DATA_END, recall.DATA_BEGIN))
    return fx.table(spark, sf, "documents").select("doc_id", F.sha2(safe, 256).alias("safe"), F.contains(planted, F.lit(recall.DATA_END)).alias("planted"))


# -- stems -----------------------------------------------------------------------------------------------------------------------

#: Endings put to the documents' words, so that every rule has words.
_ENDINGS = (
    "", "s", "sses", "ies", "eed", "ed", "ing", "ating", "ly", "y", "ational", "tional", "enci", "izer", "ousli", "ization", "alism", "iveness", "aliti", "biliti",
    "icate", "ative", "alize", "ical", "ful", "ness", "al", "ance", "er", "able", "ement", "ment", "ent", "sion", "tion", "ion", "ou", "ism", "ate", "ous", "ive", "ize", "e", "ell",
)
_V, _C = "[aeiouy]", "[^aeiouy]"


def _cut(suffix: str, x: str = "x") -> str:
    return f"left({x}, length({x}) - {len(suffix)})"


def _more(r: str, m: int) -> str:
    """Whether ``r``, whose consonant y are written Y, measures more than m."""
    return f"regexp_matches({r}, '{(_V + '+' + _C + '+') * m}{_V}+{_C}')"


def _cvc(r: str) -> str:
    return f"regexp_matches({r}, '{_C}{_V}[^aeiouywxY]$')"


def _exchange(table: dict[str, str], m: int) -> str:
    """The longest suffix of a table exchanged where the rest measures more than m."""
    longest = sorted(table, key=len, reverse=True)
    return "CASE " + " ".join(f"WHEN x LIKE '%{s}' THEN CASE WHEN {_more(_cut(s), m) if m >= 0 else 'true'} THEN {_cut(s)} || '{table[s]}' ELSE x END" for s in longest) + " ELSE x END"


def _stem_sql(words: str) -> str:
    """CTEs that end in stems (w, stem), for the words of ``words`` (w)."""
    gone = {s: _cut("ion" if s in ("sion", "tion") else s) for s in sorted(stem.LAST, key=len, reverse=True)}
    last = "CASE " + " ".join(f"WHEN x LIKE '%{s}' THEN CASE WHEN {_more(cut, 1)} THEN {cut} ELSE x END" for s, cut in gone.items()) + " ELSE x END"
    one = f"{_more('r', 0)} AND NOT {_more('r', 1)}"
    steps = [
        _exchange(stem.PLURALS, -1),
        f"""CASE WHEN x LIKE '%eed' THEN CASE WHEN {_more(_cut('eed'), 0)} THEN {_cut('d')} ELSE x END
          WHEN r IS NULL OR NOT regexp_matches(r, '{_V}') THEN x WHEN regexp_matches(r, '(at|bl|iz)$') THEN r || 'e'
          WHEN length(r) > 1 AND right(r, 1) = r[-2:-2] AND regexp_matches(r, '[^aeiouylsz]$') THEN left(r, length(r) - 1) WHEN {one} AND {_cvc('r')} THEN r || 'e' ELSE r END""",
        f"CASE WHEN lower(right(x, 1)) = 'y' AND regexp_matches({_cut('y')}, '{_V}') THEN {_cut('y')} || 'i' ELSE x END",
        _exchange(stem.DOUBLE, 0), _exchange(stem.SINGLE, 0), last,
        f"CASE WHEN x LIKE '%e' AND ({_more(_cut('e'), 1)} OR {_more(_cut('e'), 0)} AND NOT {_cvc(_cut('e'))}) THEN {_cut('e')} ELSE x END",
        f"CASE WHEN x LIKE '%ll' AND {_more('x', 1)} THEN {_cut('l')} ELSE x END",
    ]
    marked = r"regexp_replace(regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiou])y', '\1Y', 'g'), 'yy', 'yY', 'g')"
    ctes = [f"x0 AS (SELECT w, {marked} AS x FROM {words} WHERE regexp_full_match(w, '[a-z]{{3,}}'))"]
    for n, step in enumerate(steps, 1):
        rest = f"CASE WHEN x LIKE '%ing' THEN {_cut('ing')} WHEN x LIKE '%ed' AND x NOT LIKE '%eed' THEN {_cut('ed')} END AS r"
        ctes.append(f"x{n} AS (SELECT w, {step} AS x FROM (SELECT *, {rest} FROM x{n - 1}))")
    ctes.append(f"stems AS (SELECT w, lower(x) AS stem FROM x{len(steps)} UNION ALL SELECT w, w FROM {words} WHERE NOT regexp_full_match(w, '[a-z]{{3,}}'))")
    return ",\n".join(ctes)


@query(
    f"""WITH plain AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\pL\\pN]+')) AS p FROM documents),
  words AS (SELECT DISTINCT p || [{", ".join(f"'{e}'" for e in _ENDINGS)}][1 + (length(p) * 7 + instr('abcdefghijklmnopqrstuvwxyz', p[1])) % {len(_ENDINGS)}] AS w FROM plain WHERE p <> '' UNION SELECT p FROM plain WHERE p <> ''),
  {_stem_sql("words")} SELECT w AS word, stem FROM stems"""
)
def stem_words(spark, sf):
    """Stems of the documents' words, as they are and with endings."""
    plain = fx.table(spark, sf, "documents").select(F.explode(retrieval.terms_of(F.col("text"))).alias("p")).distinct()
    endings = F.array(*[F.lit(e) for e in _ENDINGS])
    first = F.instr(F.lit("abcdefghijklmnopqrstuvwxyz"), F.substring("p", 1, 1))
    ending = F.get(endings, ((F.length("p") * 7 + first) % len(_ENDINGS)).cast("int"))
    words = plain.select(F.explode(F.array("p", F.concat("p", ending))).alias("word")).distinct()
    return words.select("word", stem.stemmed(F.col("word")).alias("stem"))


@query(
    """SELECT source AS repo, 'docs/' || doc_id || '.md' AS path, octet_length(encode(coalesce(text, ''))) AS n_bytes, md5(coalesce(text, '')) AS text_md5 FROM documents
  UNION ALL SELECT repo, path, octet_length(encode(path || repo || n)), md5(path || repo || n) FROM (SELECT source AS repo, count(*) AS n FROM documents GROUP BY ALL),
    unnest(['README.md', '.cursorrules', 'docs/.notes.MD']) u(path)"""
)
def repo_docs(spark, sf):
    """The documents as files of a tree a source, beside others that discovery passes over, and read again."""
    d = fx.table(spark, sf, "documents")
    files = d.select(F.col("source").alias("repo"), F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), "text")
    names = [*("README.md", ".cursorrules", "docs/.notes.MD"), *("notes.md", "docs/notes.txt", "docs/.drafts/a.md", "docs/large.md")]
    others = d.groupBy(F.col("source").alias("repo")).agg(F.count("*").alias("n")).withColumn("path", F.explode(F.array(*map(F.lit, names))))
    text = F.when(F.col("path") == "docs/large.md", F.repeat(F.lit("x"), docs.MAX_BYTES + 1)).otherwise(F.concat("path", "repo", "n"))
    root = f"{scratch_dir(spark)}/tree-{uuid.uuid4().hex}"
    docs.write_repo_docs(files.unionByName(others.select("repo", "path", text.alias("text"))), root)
    read = docs.read_repo_docs(spark, root)
    return read.select("repo", "path", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("text_md5"))
