"""Several tables that change as one unit.

A batch writes its files aside and then puts one manifest, named by the batch's number,
in place by a rename that fails where the name exists. Readers follow manifests, so a
batch is there whole or not at all, and one that runs again changes nothing. Files that
no manifest names are left-overs of a batch that was killed.

A table grows by ``append``, stands anew with each batch by ``replace``, or is kept in
buckets, of which a batch writes those it touches and leaves the rest where they are.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFESTS, _DATA, _BUCKET = "manifests", "data", "_bucket"


@dataclass(frozen=True)
class Change:
    """What a batch does to a table: ``append``, ``replace``, or new contents of the given ``buckets`` (``rows`` have ``_bucket``)."""

    rows: DataFrame
    how: str = "append"
    buckets: tuple[int, ...] = ()


def bucket_of(buckets: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias(_BUCKET)


def _fs(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, root: str) -> dict[int, dict]:
    """Committed batches by number, first to last."""
    folder, fs = _fs(spark, f"{root}/{_MANIFESTS}")
    if not fs.exists(folder):
        return {}
    rows = spark.read.text(f"{root}/{_MANIFESTS}/*.json", wholetext=True).collect()
    return {m["batch"]: m for m in sorted((json.loads(r.value) for r in rows), key=lambda m: m["batch"])}


def commit(spark: SparkSession, root: str, batch: int, tables: dict[str, Change]) -> bool:
    """Write the tables of a batch and switch to them at once; False if that batch is there already."""
    done, fs = _fs(spark, f"{root}/{_MANIFESTS}/{batch:012d}.json")
    if fs.exists(done):
        return False
    named = {}
    for name, change in tables.items():
        at = f"{_DATA}/{name}/{batch:012d}-{uuid.uuid4().hex}"
        writer = change.rows.write.option("compression", "zstd")
        (writer.partitionBy(_BUCKET) if change.how == "buckets" else writer).parquet(f"{root}/{at}")
        fields = StructType([f for f in change.rows.schema if f.name != _BUCKET])
        named[name] = {"path": at, "how": change.how, "buckets": list(change.buckets), "schema": fields.json()}
    draft, _ = _fs(spark, f"{root}/{_MANIFESTS}/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"batch": batch, "tables": named}).encode()))
    out.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(done.toUri() if done.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, done, options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        fs.delete(draft, False)
        return False
    return True


def places(spark: SparkSession, root: str, table: str, before: int | None = None, known: dict[int, dict] | None = None) -> tuple[list[str], dict[int, str], str | None]:
    """Folders of a table, the folder of each of its buckets, and its schema, as batches below ``before`` left it."""
    folders, buckets, schema = [], {}, None
    for n, m in (manifests(spark, root) if known is None else known).items():
        found = m["tables"].get(table)
        if found is None or before is not None and n >= before:
            continue
        schema = found["schema"]
        if found["how"] == "replace":
            folders = []
        if found["how"] == "buckets":
            buckets |= {b: found["path"] for b in found["buckets"]}
        else:
            folders.append(found["path"])
    return folders, buckets, schema


def read(spark: SparkSession, root: str, table: str, schema: str | None = None, before: int | None = None, only: list[int] | None = None, known: dict[int, dict] | None = None) -> DataFrame:
    """A table as committed, or as batches below ``before`` left it; ``schema`` is what it has before the first of them.

    ``only`` names the buckets to read, and ``known`` are manifests that have been read already.
    """
    folders, buckets, found = places(spark, root, table, before, known)
    if found is None:
        if schema is None:
            raise ValueError(f"nothing has been committed to {table}")
        return spark.createDataFrame([], schema)
    fields = StructType.fromJson(json.loads(found))
    # a bucket that a batch emptied has no folder
    wanted = [f"{at}/{_BUCKET}={b}" for b, at in sorted(buckets.items()) if only is None or b in only]
    at = folders + [w for w in wanted if (p := _fs(spark, f"{root}/{w}"))[1].exists(p[0])]
    return spark.read.schema(fields).parquet(*[f"{root}/{x}" for x in at]) if at else spark.createDataFrame([], fields)


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Delete what no manifest names: left-overs, replaced tables and buckets. Not while a batch is being written."""
    known, kept = manifests(spark, root), set()
    names = {t for m in known.values() for t in m["tables"]}
    for name in names:
        folders, buckets, _ = places(spark, root, name, known=known)
        kept |= {*folders, *buckets.values()}
    gone = []
    for name in names:
        folder, fs = _fs(spark, f"{root}/{_DATA}/{name}")
        for status in fs.listStatus(folder):
            at = f"{_DATA}/{name}/{status.getPath().getName()}"
            if at not in kept:
                fs.delete(status.getPath(), True)
                gone.append(at)
    return sorted(gone)
