"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node (``large``: the larger ones) to the least of them and the node."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``u``, ``v`` (bigint) to ``node``, ``root``: the least node reachable, for each node with an edge.

    Each round ends in a written table, so lost executors cost one round, and they end
    when a round changes nothing; it is an error if ``rounds`` don't suffice. No step
    collects links or nodes.
    """
    now = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        after = written(_stars(_stars(now, True), False))
        forget(now)
        now = after
        r = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        # stars alone, each node linked to one root that is no leaf: two equal rounds
        if tuple(r) == mark or r[0] == 0:
            break
        mark = tuple(r)
    else:
        raise ValueError(f"the components still changed in round {rounds}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
