"""Running values of a key that may hold most rows: a parallel prefix scan.

Rows are range-split by key and order, so a large key spans many parts. Each part adds
up its own rows; what the parts before it hold of the same key is carried over. At most
one key reaches into a part from before, so there are no more carries than parts.
"""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows of a key that one task takes; with larger keys rows are split.
LARGEST = 1_000_000
How = Literal["sum", "max"]
_ADD = {"sum": F.sum, "max": F.max}


def _both(how: How, a: Column, b: Column) -> Column:
    """Of two values that may be null."""
    return F.greatest(a, b) if how == "max" else F.coalesce(a + b, a, b)


def running(rows: DataFrame, keys: list[str], order: list[str], value: str, how: How = "sum", name: str = "running", own: bool = True, largest: int = LARGEST) -> DataFrame:
    """``rows`` with ``name``: the sum or maximum of ``value`` over the rows of the key up to each, itself included if ``own``.

    ``order`` must tell a key's rows apart; nulls come first. Null values count as none, and null keys are a key.
    """
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    upto = 0 if own else -1
    if most <= largest:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
        return rows.withColumn(name, _ADD[how](value).over(w))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // largest))
    split = written(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    totals = split.groupBy(*keys, "_part").agg(_ADD[how](value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_carry", _ADD[how]("_total").over(before)).filter("_carry is not null")
    carry = F.broadcast(carried.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("_part").alias("_p"), "_carry"))  # ``parts`` rows at most
    w = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    here = split.withColumn("_here", _ADD[how](value).over(w))
    on = F.col("_part") == F.col("_p")
    for n, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{n}"))
    joined = here.join(carry, on, "left")
    return joined.select(*rows.columns, _both(how, F.col("_here"), F.col("_carry")).alias(name))


def trailing_count(rows: DataFrame, key: str, us: str, window: int, name: str = "n", largest: int = LARGEST) -> DataFrame:
    """``rows`` with the number of rows of the key within the last ``window`` microseconds up to each, all of its instant included.

    The window is open below. Each instant counts up once and down once a window later,
    so the count is a running sum; a key's rows of one instant are one before any moves.
    Rows without an instant count none.
    """
    each = rows.filter(F.col(us).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(us).alias("_us")).agg(F.count("*").alias("_d"))
    both = each.select("_key", F.inline(F.array(F.struct("_us", "_d"), F.struct((F.col("_us") + window).alias("_us"), (-F.col("_d")).alias("_d")))))
    net = both.groupBy("_key", "_us").agg(F.sum("_d").alias("_d"))
    counted = running(net, ["_key"], ["_us"], "_d", "sum", "_n", largest=largest).select("_key", "_us", "_n")
    joined = rows.join(counted, F.col(key).eqNullSafe(F.col("_key")) & (F.col(us) == F.col("_us")), "left")
    return joined.select(*rows.columns, F.coalesce("_n", F.lit(0).cast("bigint")).alias(name))
