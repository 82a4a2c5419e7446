"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where the session has it. Unset, as in tests on one
    machine, a temporary folder serves a local master and the warehouse any other.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        at = f"{tempfile.gettempdir()}/claimlake-scratch" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return at.rstrip("/")


def written(df: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends here.

    Later stages then neither recompute the work nor lose it with an executor.
    """
    spark = df.sparkSession
    at = f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"
    out = df.coalesce(partitions) if partitions else df
    out.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def fingerprint(df: DataFrame) -> str:
    """Of the files that ``df`` reads: their paths, sizes and times. No column of theirs is read."""
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]
    files = df.select(F.xxhash64(*meta).alias("x"), F.xxhash64(F.lit(1), *meta).alias("y")).distinct()
    n, x, y = files.agg(F.count("*"), F.bit_xor("x"), F.bit_xor("y")).first()
    return f"{n}-{(x or 0) & (1 << 64) - 1:016x}{(y or 0) & (1 << 64) - 1:016x}"


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    base = scratch_dir(spark).removeprefix("file://")
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"{base}/t-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing in use comes from.

    Its cleaner follows the driver's garbage collection, which a driver with little to
    do runs rarely, while the executors' disks fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
