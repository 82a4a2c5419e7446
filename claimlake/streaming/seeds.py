"""Re-seeding that reads and writes only the buckets of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scd
from ..sources import units
from ..sources.scratch import written
from .jobs import _run, batch_clock

_PLACE = ["repo", "path", "ordinal"]
LIVE = "repo string, path string, ordinal int, id string, content_sha256 string, statement string, recorded_at timestamp"
CLOSED = f"{LIVE}, superseded_at timestamp, superseded_by string"


def stream_seed_buckets(chunks: DataFrame, root: str, checkpoint: str, ts: str = "ts", buckets: int = 64) -> StreamingQuery:
    """``seed_merge`` of each batch of chunks (repo, path, ordinal, content_sha256, statement, ts) into the tables at ``root``.

    ``live`` is kept in buckets of whole files: a batch reads and writes those that hold
    its files, and the rest stay where they are. What a batch closes is appended to
    ``closed``. Both change as one unit, once for each batch. Of a place that comes
    twice in a batch the latest chunk counts.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        place = Window.partitionBy(*_PLACE).orderBy(F.desc(ts), "content_sha256")
        rows = batch.select(*_PLACE, "content_sha256", "statement", ts).withColumn("_n", F.row_number().over(place)).filter("_n = 1").drop("_n")
        rows = written(rows.withColumn("_bucket", units.bucket_of(buckets, "repo", "path")))
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # ``buckets`` at most
        if not touched:
            return
        live = units.read(spark, root, "live", LIVE, before=n, only=touched)
        now = batch_clock(rows, live, ts)
        merged = written(scd.seed_merge(live.drop("recorded_at"), rows, now))
        since = merged.join(live.select("id", "recorded_at"), "id", "left").withColumn("recorded_at", F.coalesce("recorded_at", now))
        still = since.filter("superseded_at is null").select(*[c.split()[0] for c in LIVE.split(", ")], units.bucket_of(buckets, "repo", "path"))
        closed = since.filter("superseded_at is not null").select(*[c.split()[0] for c in CLOSED.split(", ")])
        units.commit(spark, root, n, {"live": units.Change(still, "buckets", tuple(sorted(touched))), "closed": units.Change(closed)})

    return _run(chunks, checkpoint, step)
