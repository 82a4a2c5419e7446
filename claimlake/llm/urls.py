"""URL filtering by a path-template tree.

Per host, paths are walked segment by segment. Under each node, segments that vary
(digits, long hex, or many children that are hardly ever seen twice) become a
wildcard, and so do siblings whose labelled share does not differ from the node's in a
two-sided test. Of the others, those above the node's share that don't differ from one
another merge into one branch, as do those below. Each template's labelled purity is
smoothed with its parent's, from the host down, and a page is blocked where its
template's purity exceeds the threshold. The first ``DEPTH`` levels are always walked,
deeper ones as long as a node has labels of both kinds, however deep that is. Labels
are the verdicts of explicit rules, or any column given. Only counts by distinct path
and by node are shuffled; nodes and paths with more than a thousandth of the rows,
which are a thousand at most, are joined by broadcast, so none is one task's.

Defined results: null urls and urls without ``://`` have an empty host and path and
are judged like any other host's; a literal segment such as ``*`` is never the node
of a wildcard, nor an empty one that of a path's end; repeated rows get the same verdict; empty tables
give none; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written

#: Levels of the tree that are walked whatever the labels.
DEPTH = 3
#: Children from which a node's children may be taken for variable, and the most pages of each on average.
MANY, FEW = 12, 3.0
#: Weight of the parent's purity, of the critical value, and the purity above which a template is rejected.
SMOOTH, CRITICAL, REJECT = 4.0, 1.96, 0.6

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Names of branches that stand for several segments, and what leads a literal segment that reads like one of them.
WILD, ABOVE, BELOW, LITERAL = "*", "(+)", "(-)", "\\"


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, _UPPER, _UPPER.lower()), F.regexp_extract(tail, r"^[^?#]*", 0)


def rule_of(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits, else nulls."""
    pattern = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):  # later ones, which are longer, take precedence
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pattern = F.when(fits, F.lit(r.pattern)).otherwise(pattern)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pattern, verdict


def _variable(segment: Column) -> Column:
    return segment.rlike(r"^[0-9]+(\.[A-Za-z]+)?$|^[0-9A-Fa-f-]{12,}$|[0-9]{5,}")


def _literal(segment: Column) -> Column:
    """The name of a segment's own branch: no other segment, wildcard, merged branch, rest or end of a path has it."""
    marked = segment.isin("", WILD, "**", ABOVE, BELOW) | segment.startswith(LITERAL)
    return F.when(marked, F.concat(F.lit(LITERAL), segment)).otherwise(segment)


def _alike(lab: str, bad: str, share: Column) -> Column:
    """Whether a branch's labelled share may be ``share`` by a two-sided test."""
    n = F.greatest(F.col(lab), F.lit(1))
    return (F.col(lab) == 0) | (F.abs(F.col(bad) / n - share) <= CRITICAL * F.sqrt(share * (1 - share) / n))


def _children(now: DataFrame) -> DataFrame:
    """host, template, seg of each branch below the nodes of ``now`` (host, template, seg, n, lab, bad) and its ``child`` name."""
    node = ["host", "template"]
    kids = now.groupBy(*node, "seg").agg(F.sum("n").alias("cn"), F.sum("lab").alias("clab"), F.sum("bad").alias("cbad"))
    of_node = kids.groupBy(*node).agg(F.count("*").alias("kinds"), F.sum("cn").alias("pn"), F.sum("clab").alias("plab"), F.sum("cbad").alias("pbad"))
    share = F.col("pbad") / F.greatest(F.col("plab"), F.lit(1))
    many = (F.col("kinds") >= MANY) & (F.col("pn") <= FEW * F.col("kinds"))
    wild = _variable(F.col("seg")) | many | _alike("clab", "cbad", share)
    side = F.when(F.col("seg").isNull() | wild, F.lit(None)).otherwise(F.col("cbad") / F.greatest(F.col("clab"), F.lit(1)) > share)
    kids = written(join_hot(kids, of_node, node, "kinds").withColumn("wild", wild).withColumn("side", side))
    sided = kids.filter("side is not null")
    pools = sided.groupBy(*node, "side").agg(F.sum("clab").alias("slab"), F.sum("cbad").alias("sbad"), F.count("*").alias("same"))
    kids = join_hot(sided, pools, [*node, "side"], "same").unionByName(kids.filter("side is null"), allowMissingColumns=True)
    merged = (F.col("same") > 1) & _alike("clab", "cbad", F.col("sbad") / F.greatest(F.col("slab"), F.lit(1)))
    child = F.when(F.col("seg").isNull(), "").when(F.col("wild"), WILD).when(merged, F.when(F.col("side"), ABOVE).otherwise(BELOW)).otherwise(_literal(F.col("seg")))
    return kids.select(*node, "seg", child.alias("child"), "cn")


def template_purity(pages: DataFrame) -> DataFrame:
    """``pages`` (key, host, path, label) to (key, template, purity); label is 1 to reject, 0 to keep, or null."""
    rows = pages.select("host", F.split(F.regexp_replace("path", r"^/", ""), "/").alias("s"), "label", "key")
    # counts of each distinct path stand for its pages from here on
    paths = written(rows.groupBy("host", "s").agg(F.count("*").alias("n"), F.count("label").alias("lab"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")))
    total = paths.agg(F.sum("lab"), F.sum("bad")).first()
    prior = ((total[1] or 0) + 1.0) / ((total[0] or 0) + 2.0)
    node = ["host", "template"]
    sums = [F.count("*").alias("paths"), F.sum("lab").alias("tlab"), F.sum("bad").alias("tbad")]
    hosts = paths.groupBy("host").agg(*sums)
    hosts = hosts.select("host", "paths", ((F.col("tbad") + SMOOTH * prior) / (F.col("tlab") + SMOOTH)).alias("purity"), F.lit(True).alias("more"))
    now = join_hot(paths, hosts, ["host"], "paths").select("host", "s", "n", "lab", "bad", F.lit("").alias("template"), "purity", "more")
    done: list[DataFrame] = []
    for level in itertools.count():
        # the end of a path is a branch of its own; a blank last segment is none
        seg = F.nullif(F.get("s", F.lit(level)), F.lit("")) if level == 0 else F.get("s", F.lit(level))
        now = now.withColumn("seg", seg)
        named = _children(now)
        mark = F.coalesce(F.concat(F.lit("/"), "seg"), F.lit(""))
        now = join_hot(now.withColumn("_seg", mark), named.withColumn("_seg", mark).drop("seg"), [*node, "_seg"], "cn").drop("_seg", "cn")
        ended = F.col("seg").isNull()
        now = written(now.withColumn("template", F.when(ended, F.concat("template", F.lit("/"))).otherwise(F.concat("template", F.lit("/"), "child"))).drop("child", "seg", "more"))
        below = now.groupBy(*node).agg(*sums, F.min("purity").alias("up"))
        both = (F.col("tbad") > 0) & (F.col("tbad") < F.col("tlab"))
        below = below.select(*node, "paths", ((F.col("tbad") + SMOOTH * F.col("up")) / (F.col("tlab") + SMOOTH)).alias("purity"), (both | F.lit(level + 1 < DEPTH)).alias("more"))
        open_ = (F.size("s") > level + 1) & ~((F.size("s") == level + 2) & (F.get("s", F.lit(level + 1)) == ""))
        now = written(join_hot(now.drop("purity"), below, node, "paths").drop("paths"))
        going = open_ & F.col("more")
        done.append(now.filter(~going).select("host", "s", F.when(open_, F.concat("template", F.lit("/**"))).otherwise(F.col("template")).alias("template"), "purity", "n"))
        now = now.filter(going)
        if now.isEmpty():
            break
    return join_hot(rows.select("key", "host", "s"), reduce(DataFrame.unionByName, done), ["host", "s"], "n").select("key", "template", "purity")


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each row."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    pattern, verdict = rule_of(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", pattern).withColumn("ruled", verdict)
    label = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    packed = F.struct("page_id", "host", "path", "rule", "ruled")
    found = template_purity(rows.select(packed.alias("key"), "host", "path", label.alias("label")))
    by_template = F.when(F.col("purity") > REJECT, "block").otherwise("allow")
    return found.select("key.page_id", "key.host", "key.path", "key.rule", F.coalesce("key.ruled", by_template).alias("verdict"), "template", "purity")
