"""De-duplication as claims arrive: the survivor of each statement is kept in state, in groups of statements."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.dedup import SMALL
from ..sources.scratch import written

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of statements whose survivors are one row of state: a row costs calls to the state's server each batch, a statement none. Fixed for a checkpoint.
GROUPS = 1024
_COMBINED = pa.schema([("hash", pa.string()), ("ids", pa.list_(pa.string())), ("us", pa.list_(pa.int64())), ("least_us", pa.int64()), ("least_id", pa.string())])
_KEPT = "hash array<string>, us array<bigint>, id array<string>"
_JUDGED = "hash string, ids array<string>, us array<bigint>, old string, old_us bigint, survivor string, survivor_us bigint"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for as long as a query is started."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hash, id, us) to one row for each hash of a batch, so that a statement that many rows repeat crosses the network as lists."""
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b]).sort_by([("hash", "ascending"), ("us", "ascending"), ("id", "ascending")]).combine_chunks()
        code = rows["hash"].combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.concatenate([[0], np.nonzero(np.diff(code))[0] + 1])
        offsets = pa.array(np.append(starts, len(code)).astype(np.int32))
        ids, us, at = rows["id"].combine_chunks(), rows["us"].combine_chunks(), pa.array(starts)
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (ids, us)]
        yield pa.RecordBatch.from_arrays([pc.take(rows["hash"].combine_chunks(), at), *lists, pc.take(us, at), pc.take(ids, at)], schema=_COMBINED)


def _survivors() -> StatefulProcessor:
    """The state of a group of statements. The class is made here, so that it travels whole to where state is set up."""

    Judged = Row(*[c.split()[0] for c in _JUDGED.split(", ")])  # noqa: N806

    class Survivors(StatefulProcessor):
        """State: when the survivor of each statement of the group was recorded, and its id; read and put back once a batch.

        Of a batch the last list of each statement is held.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.kept = handle.getValueState("survivors", _KEPT)

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self.kept.update((initialState["hash"], initialState["us"], initialState["id"]))

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            kept = {h: (us, i) for h, us, i in zip(*self.kept.get(), strict=True)} if self.kept.exists() else {}
            best, last = {}, {}
            for r in rows:
                h, here = r["hash"], (r["least_us"], r["least_id"])
                if h in last:
                    yield Judged(h, *last[h], None, None, None, None)
                before = best.get(h) or kept.get(h)
                best[h], last[h] = here if before is None or here < before else before, (r["ids"], r["us"])
            for h, came in last.items():
                old = kept.get(h)
                beaten = old if old and best[h] != old else (None, None)  # a claim recorded earlier came later
                yield Judged(h, *came, beaten[1], beaten[0], best[h][1], best[h][0])
            if any(kept.get(h) != x for h, x in best.items()):
                kept |= best
                self.kept.update((list(kept), [x[0] for x in kept.values()], [x[1] for x in kept.values()]))

        def close(self) -> None:
            pass

    return Survivors()


def _of(claims: DataFrame) -> DataFrame:
    live = claims.filter("superseded_at is null and statement_sha256 is not null")
    return live.select(F.col("statement_sha256").alias("hash"), "id", F.unix_micros("recorded_at").alias("us"))


def closures_of(judged: DataFrame) -> DataFrame:
    """What the state gave for one batch, as closures: id, successor, at, reason.

    Each touched statement has one survivor after the batch; whatever else came with the
    batch, or survived until then, is closed by it. The clock is the batch's latest
    claim, so a batch that runs again gives the same closures.
    """
    named = judged.filter("survivor is not null").groupBy("hash").agg(
        F.min(F.struct("survivor_us", "survivor")).alias("s"),
    ).select("hash", "s.survivor_us", "s.survivor")
    came = judged.select("hash", F.inline(F.arrays_zip("ids", "us"))).toDF("hash", "id", "us")
    latest = came.agg(F.max("us").alias("latest"))
    members = came.unionByName(judged.filter("old is not null").select("hash", F.col("old").alias("id"), F.col("old_us").alias("us")))
    named = F.broadcast(named) if named.limit(SMALL + 1).count() <= SMALL else named
    lost = members.join(named, "hash").filter("id != survivor").join(F.broadcast(latest))
    at = F.timestamp_micros(F.greatest("latest", "us", "survivor_us") + 1)  # nothing closes at the instant at which it was recorded
    return lost.select("id", F.col("survivor").alias("successor"), at.alias("at"), F.lit("duplicate").alias("reason"))


def stream_closures(claims: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, known: DataFrame | None = None) -> StreamingQuery:
    """Closures of duplicates as claims (id, statement_sha256, recorded_at, superseded_at) arrive; ``write`` gets those of each batch.

    After each batch the live claims are those that ``dedup_claims`` would leave. Only
    groups of statements that come in a batch are looked at. ``known`` claims, of before the
    first batch, have survivors too. Closed claims, and those without a hash, take no part.
    """
    spark = claims.sparkSession
    combined = "hash string, ids array<string>, us array<bigint>, least_us bigint, least_id string"
    group = F.pmod(F.xxhash64("hash"), F.lit(GROUPS)).alias("group")
    rows = _of(claims).mapInArrow(_combine, combined)
    initial = None
    if known is not None:
        least = _of(known).groupBy("hash").agg(F.min(F.struct("us", "id")).alias("s"))
        each = least.groupBy(group).agg(F.collect_list(F.struct("hash", "s.us", "s.id")).alias("k"))
        initial = each.select("group", *[F.col(f"k.{c}").alias(c) for c in ("hash", "us", "id")]).groupBy("group")
    judged = rows.select(group, "*").groupBy("group").transformWithState(_survivors(), _JUDGED, outputMode="Append", timeMode="None", initialState=initial)

    def step(batch: DataFrame, n: int) -> None:
        write(closures_of(written(batch)), n)

    with state_store(spark):
        return judged.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
