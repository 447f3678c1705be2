"""The change feed as a stream: coalescing, replay and late operations."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators.maintain import latest, op_name
from marginalia.sources.snapshots import Store
from marginalia.sources.tables import materialize

CHANGES = "op_id bigint, vault string, path string, op string, op_time timestamp, arrived_at timestamp"
T = TypeVar("T")


class Buffer:
    """Collects elements by key, the newest of a key last, and flushes when so many keys are held."""

    def __init__(self, handle: Callable[[list[T]], Any], key: Callable[[T], str], threshold: int = 3):
        self.handle, self.key, self.threshold = handle, key, threshold
        self.held: dict[str, T] = {}

    def add(self, element: T) -> None:
        self.held.pop(self.key(element), None)
        self.held[self.key(element)] = element
        if len(self.held) >= self.threshold:
            self.flush()

    def flush(self) -> None:
        if self.held:
            batch, self.held = list(self.held.values()), {}
            self.handle(batch)


def source(spark: SparkSession, folder: str, pattern: str = "change_ops.parque[t]", files_per_trigger: int | None = None) -> DataFrame:
    """The change operations that arrive as Parquet files; the pattern names a file or a folder of files."""
    reader = spark.readStream.schema(CHANGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{pattern}")


def merge_state(state: DataFrame | None, ops: DataFrame) -> DataFrame:
    """``(vault, path, op_time, op_id, op)``: the last operation of each path, old state and new ones.

    The operation's own time decides, so one that arrives late can't override a newer one, and a
    batch that is replayed after a failure changes nothing.
    """
    known = ops.select("vault", "path", "op_time", "op_id", op_name(F.col("op")).alias("op")).where("path is not null and op is not null")
    rows = known if state is None else known.unionByName(state.select(known.columns))
    return latest(rows, ["vault", "path"], "op_time", "op_id")


def state(store: Store, name: str = "net_changes") -> DataFrame | None:
    """The last operation of each path as stored: the snapshot with the deltas merged in."""
    rows = store.load_with_deltas(name)
    return None if rows is None else latest(rows, ["vault", "path"], "op_time", "op_id")


def compact(store: Store, name: str = "net_changes") -> None:
    """Merges the deltas into a new snapshot and drops them; harmless if it is broken off and run again."""
    parts = store.deltas(name)
    merged = state(store, name)
    if parts and merged is not None:
        store.save(name, merged, merged=int(parts[-1].rstrip("/").rpartition("/")[2]))
        store.drop_deltas(parts)


def effective(before: DataFrame | None, ops: DataFrame) -> DataFrame:
    """``(vault, path, op, replace)``: what the operations of a batch do to an index.

    The later of a path's last add and last delete counts, unless an earlier batch brought a newer
    one. An add after a delete of the same batch replaces the path; a lone add of a path that is
    there changes nothing, which the index decides.
    """
    known = ops.select("vault", "path", op_name(F.col("op")).alias("op"), F.struct("op_time", "op_id").alias("__at")).where("path is not null and op is not null")
    last = known.groupBy("vault", "path").agg(
        F.max(F.when(F.col("op") == "add", F.col("__at"))).alias("__add"), F.max(F.when(F.col("op") == "delete", F.col("__at"))).alias("__delete"), F.max("__at").alias("__last")
    )
    if before is not None:
        old = before.select(F.col("vault").alias("__vault"), F.col("path").alias("__path"), F.struct("op_time", "op_id").alias("__old"))
        last = last.join(old, F.col("vault").eqNullSafe(F.col("__vault")) & (F.col("path") == F.col("__path")), "left").where("__old is null or __last >= __old")
    adds = F.coalesce(F.col("__add") >= F.col("__delete"), F.col("__add").isNotNull())
    return last.select("vault", "path", F.when(adds, "add").otherwise("delete").alias("op"), (adds & F.col("__delete").isNotNull()).alias("replace"))


def stop(spark: SparkSession, name: str) -> None:
    """Stops the running query of a name, if there is one."""
    for query in spark.streams.active:
        if query.name == name:
            query.stop()


def start(
    changes: DataFrame, store: Store, checkpoint: str, name: str = "net_changes", once: bool = False, compact_every: int = 20, then: Callable[[DataFrame], Any] | None = None
) -> StreamingQuery:
    """Applies the stream to the stored net changes, a micro-batch at a time; a running one of the same
    store is stopped first.

    The pending changes of a batch are coalesced by path and written as a delta under the batch's
    number, so a batch costs what it holds and not what the state holds, and a replayed one replaces
    itself; every so many batches the deltas are merged into the snapshot. ``then`` gets what each
    batch does to an index, before the batch counts as done, so it may come again. The trigger
    throttles to one flush in ten seconds.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if then is not None:
            then(materialize(effective(state(store, name), batch)))
        store.add_delta(name, merge_state(None, batch), number)
        if (number + 1) % compact_every == 0:
            compact(store, name)

    own = f"{store.root}/{name}"
    stop(store.spark, own)
    writer = changes.writeStream.queryName(own).foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def replay(spark: SparkSession, folder: str, work: str) -> DataFrame:
    """``(vault, path, op, op_time)`` after all change files of a folder went through the stream."""
    store = Store(spark, f"{work}/state", "changes")
    query = start(source(spark, folder), store, f"{work}/checkpoint", once=True)
    query.awaitTermination()
    last = state(store)
    return (merge_state(None, spark.createDataFrame([], CHANGES)) if last is None else last).select("vault", "path", "op", "op_time")


def counts_by_window(changes: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """``(start, op, n)``: operations in windows of their own time; later ones than ``late`` are dropped."""
    timed = changes.withColumn("op", op_name(F.col("op"))).where("op is not null and op_time is not null").withWatermark("op_time", late)
    return timed.groupBy(F.window("op_time", width).alias("w"), "op").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "op", "n")
