"""Replicas, absence counters and freshness kept up to date by Structured Streaming.

State lives in Spark's state store, recovered from the checkpoint after a failure; that of absences is the rows written so far. Events are ordered by version or run, not by
event time, so no watermark is used: a late or replayed event has a lower version than the stored one and loses.

What a stream writes is a folder with manifests (sources/manifest.py). A micro-batch counts once a manifest names its folder, and
once only, however often it is repeated. When more than ``EVERY`` batches have piled up they are folded into one new folder, which a
manifest puts in their place while the stream goes on; readers that hold an older manifest go on reading what it names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricetrail.operators.changes import KINDS, snapshot
from pricetrail.operators.runs import describe, latest_runs
from pricetrail.sources.manifest import Manifest, Part, Store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Batches that pile up before they are folded into one.
EVERY = 16
Fold = Callable[[DataFrame], DataFrame]
Step = Callable[[DataFrame, DataFrame | None], DataFrame]


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on disk, so that it may outgrow executor memory. Holds for the session's streams from then on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _written(store: Store, at: Manifest | None = None) -> DataFrame:
    """The rows of all batches that a manifest names."""
    at = at or store.read()
    if not at.parts:
        raise ValueError("the stream has not written anything yet")
    return store.spark.read.parquet(*[f"{store.folder}/{p.folder}" for p in at.parts])


def fold_batches(spark: SparkSession, folder: str, fold: Fold) -> Manifest:
    """Put all batches there are into one folder and swap it in. Batches that arrive meanwhile stay beside it."""
    store = Store(spark, folder)
    start = store.read()
    if len(start.parts) < 2:
        return start
    whole = fold(_written(store, start))
    name = store.write(whole, "folded")
    part = Part(name, start.parts[0].first, start.parts[-1].last, sum(p.rows for p in start.parts))

    def swap(current: Manifest) -> dict | None:
        if current.parts[: len(start.parts)] != start.parts:
            return None  # another fold was faster
        return {"generation": uuid.uuid4().hex, "parts": (part, *current.parts[len(start.parts) :])}

    return store.update(swap)


def _write_batches(updates: DataFrame, folder: str, checkpoint: str, once: bool, fold: Fold, every: int = EVERY, step: Step | None = None) -> StreamingQuery:
    """Write each micro-batch of updates into a folder of its own and add it to the manifest, a repeated batch only once.

    ``step`` makes new state of a batch and of all rows written before (none at first). A batch that is named has been counted.
    """
    use_rocksdb(updates.sparkSession)

    def save(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, folder)
        if step:
            before = store.read()
            if before.parts and before.parts[-1].last >= batch_id:
                return
            batch = step(batch, _written(store, before) if before.parts else None)
        name = store.write(batch, "batch")  # also when repeated: the state store has to move on
        if not batch.sparkSession.read.schema(batch.schema).parquet(f"{store.folder}/{name}").isEmpty():
            part = Part(name, batch_id, batch_id, 0)
            known = lambda m: m.parts and m.parts[-1].last >= batch_id  # noqa: E731  named before a failure
            store.update(lambda m: None if known(m) else {"parts": (*m.parts, part), "generation": m.generation or uuid.uuid4().hex})
        if len(store.read().parts) > every:
            fold_batches(batch.sparkSession, folder, fold)

    writer = updates.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_replica(changes: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the newest image of every entity. Only entities touched by a micro-batch are written.

    A change of a kind that replicas do not know fails the batch: its successors could depend on it, so it is neither applied nor left out.
    """
    refused = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("none"))))
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(refused.cast("string"))
    images = snapshot(changes.select(kind.alias("kind"), "entity_id", "version", "payload"))
    return _write_batches(images, folder, checkpoint, once, snapshot)


def read_replica(spark: SparkSession, folder: str, at: Manifest | None = None) -> DataFrame:
    """The replica: newest image of every entity over all batches of a manifest, the newest by default."""
    return snapshot(_written(Store(spark, folder), at))


def compact_replica(spark: SparkSession, folder: str) -> Manifest:
    """Fold the replica's batches into one image per entity, in place. The stream may go on meanwhile."""
    return fold_batches(spark, folder, snapshot)


def _counted(events: DataFrame, state: DataFrame | None) -> DataFrame:
    """State of the products of a batch after its events: the last closed run, absences in a row then, and the last run with a sighting.

    Events count in the order of their runs, a sighting before the end of its run. A sighting resets the counter, also one that comes
    after its run was closed; a closed run without one adds to it. Runs that were closed before change nothing, so repeated events do
    no harm. Only the runs of one batch are held per product.
    """
    runs = lambda closing: F.collect_set(F.when(F.col("closing") == closing, F.col("run")))
    rows = events.groupBy("id").agg(runs(True).alias("_c"), runs(False).alias("_s"))
    if state is None:
        rows = rows.withColumns({"run": F.lit(0), "missing_count": F.lit(0), "seen": F.lit(0)})
    else:
        rows = rows.join(_newest_counter(state), "id", "left")
    rows = rows.withColumns({n: F.coalesce(F.col(c).cast("long"), F.lit(0)) for n, c in (("_c0", "run"), ("_r0", "missing_count"), ("_s0", "seen"))})
    rows = rows.withColumn("_c", F.filter("_c", lambda r: r > F.col("_c0")))
    rows = rows.withColumn("run", F.coalesce(F.array_max("_c"), "_c0"))
    rows = rows.withColumn("_upto", F.coalesce(F.array_max(F.filter("_s", lambda r: r <= F.col("run"))), F.lit(0)))
    after = F.size(F.filter("_c", lambda r: r > F.greatest("_s0", "_upto")))
    reset = (F.col("_upto") >= F.col("_c0")) | (F.col("_s0") >= F.col("_c0"))
    quiet = F.when(F.array_contains("_s", F.col("_c0")), F.lit(0)).otherwise(F.col("_r0"))
    missing = F.when(F.size("_c") == 0, quiet).when(reset, after).otherwise(F.col("_r0") + after).cast("long")
    seen = F.greatest("_s0", F.coalesce(F.array_max("_s"), F.lit(0)))
    rows = rows.select("id", "run", missing.alias("missing_count"), seen.cast("long").alias("seen"))
    return rows.select("id", "run", "missing_count", (F.col("missing_count") >= 1).alias("possibly_inactive"), (F.col("missing_count") >= 3).alias("inactive"), "seen")


def _newest_counter(rows: DataFrame) -> DataFrame:
    """The newest state of every product: its closed run and its last sighting only grow."""
    best = F.max_by(F.struct("run", "missing_count", "possibly_inactive", "inactive", "seen"), F.struct("run", "seen"))
    return rows.groupBy("id").agg(best.alias("_c")).select("id", "_c.*")


def stream_absences(events: DataFrame, folder: str, checkpoint: str, once: bool = False, every: int = EVERY) -> StreamingQuery:
    """Count absences per product with state. ``events`` are id, run and closing: a sighting of a product in a run, or (closing) the end
    of a complete run whose scope holds the product. Runs are numbered from 1. The state is what the batches before have written: a
    batch's events are put together per product and joined with it."""
    rows = events.select(F.col("id").cast("string").alias("id"), F.col("run").cast("long").alias("run"), F.col("closing").cast("boolean").alias("closing"))
    return _write_batches(rows, folder, checkpoint, once, _newest_counter, every, _counted)


def read_absences(spark: SparkSession, folder: str, at: Manifest | None = None) -> DataFrame:
    """Counters of every product after the last run that was closed for it."""
    return _newest_counter(_written(Store(spark, folder), at)).filter("run > 0").drop("seen")


def _last_seen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.max("last_seen").alias("last_seen"))


def stream_last_seen(sightings: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the last complete run that saw each product (id, run)."""
    return _write_batches(sightings.groupBy("id").agg(F.max("run").alias("last_seen")), folder, checkpoint, once, _last_seen)


def absence_counters(spark: SparkSession, folder: str, scope: DataFrame, last_run: int | Column) -> DataFrame:
    """Absence counters of the scope's products after a run, from what stream_last_seen wrote."""
    run = F.lit(last_run) if isinstance(last_run, int) else last_run
    rows = scope.select("id").join(_last_seen(_written(Store(spark, folder))), "id", "left")
    count = (run - F.coalesce("last_seen", F.lit(0))).cast("long")
    return rows.select("id", count.alias("missing_count"), (count >= 1).alias("possibly_inactive"), (count >= 3).alias("inactive"))


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(
        F.max_by("attempt", F.struct("attempt.started_at", "attempt.id", "attempt.ended")).alias("attempt"), F.max("checked_at").alias("checked_at"))


def stream_freshness(runs: DataFrame, folder: str, checkpoint: str, once: bool = False, every: int = EVERY) -> StreamingQuery:
    """Keep the latest attempt and the latest complete refresh of every source."""
    return _write_batches(latest_runs(runs), folder, checkpoint, once, _latest, every)


def read_freshness(spark: SparkSession, folder: str, at: Column) -> DataFrame:
    """Freshness of every source at a moment, from what stream_freshness wrote."""
    return describe(_latest(_written(Store(spark, folder))), at)
