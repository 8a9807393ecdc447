"""Running the change feed as a stream."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.apply import field_state
from ..operators.delta import fan_out, split_dead_letters
from ..files import remove, subfolders
from .replica import ReplicaLog

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table_stream(spark: SparkSession, folder: str, table: str, schema: T.StructType | str, max_files: int | None = None) -> DataFrame:
    """Stream over the parquet files of one table in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs the stream over what has landed into an exactly-once file sink; reads it back."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs the stream over what has landed; a restart resumes from the checkpoint."""
    query = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def newest_of_sources(events: DataFrame, source: str) -> dict[str, dt.datetime]:
    """The last commit time of each source; bounded by the number of sources."""
    newest = events.filter(F.col(source).isNotNull() & F.col("commit_ts").isNotNull()).groupBy(source).agg(F.max("commit_ts").alias("t"))
    row = newest.agg(F.map_from_entries(F.collect_list(F.struct(source, "t"))).alias("m")).first()
    return row["m"]


def apply_feed(
    decoded: DataFrame,
    replica: ReplicaLog,
    dead_letters: str,
    checkpoint: str,
    compact_every: int = 100,
    rows_of: Callable[[DataFrame], DataFrame] = fan_out,
    lateness: dt.timedelta | None = None,
    source: str = "topic",
) -> None:
    """Applies decoded events batch by batch; refused ones go to the dead letters.

    All topics run through the one stream; ``entity`` tells them apart.  ``rows_of``
    makes one row per record out of the good events.  With ``lateness`` a source's
    events come at most so late: deletes older than the mark of all sources end
    when the replica is compacted.
    """
    marks: dict[str, dt.datetime] = {}

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # decoded once for both outputs
        good, bad = split_dead_letters(batch)
        bad.write.mode("overwrite").parquet(f"{dead_letters}/batch={batch_id}")
        replica.append(rows_of(good), batch_id)
        if lateness is not None:
            marks.update(newest_of_sources(good, source))
        batch.unpersist()
        if compact_every and batch_id and batch_id % compact_every == 0:
            replica.compact(low_water=min(marks.values()) - lateness if marks else None)

    run_batches(decoded, handle, checkpoint)


def run_with_lookup(
    stream: DataFrame,
    lookup: Callable[[], DataFrame],
    join: Callable[[DataFrame, DataFrame], DataFrame],
    found: Column,
    path: str,
    checkpoint: str,
) -> tuple[DataFrame, DataFrame]:
    """Joins each micro-batch to a table as it stands then; what finds no row waits for a later batch.

    ``lookup`` is called once per batch, so rows registered while the stream runs
    count from the next batch on, for waiting events too.  Each batch writes its
    own folders and reads those of the one before, so one that runs again gives the
    same.  Returns (joined, still waiting).
    """
    spark, kept = stream.sparkSession, stream.schema

    def handle(batch: DataFrame, batch_id: int) -> None:
        waited = f"{path}/waiting/batch={batch_id - 1}"
        rows = batch.unionByName(spark.read.schema(kept).parquet(waited)) if batch_id else batch
        joined = join(rows, lookup()).withColumn("_found", found).persist()
        joined.filter("_found").drop("_found").write.mode("overwrite").parquet(f"{path}/joined/batch={batch_id}")
        joined.filter("not _found").select(*kept.names).write.mode("overwrite").parquet(f"{path}/waiting/batch={batch_id}")
        joined.unpersist()
        if batch_id > 1:
            remove(spark, f"{path}/waiting/batch={batch_id - 2}")

    run_batches(stream, handle, checkpoint)
    batches = subfolders(spark, f"{path}/waiting", "batch")
    if not batches:
        empty = spark.createDataFrame([], kept)
        return join(empty, lookup()), empty
    return spark.read.parquet(f"{path}/joined").drop("batch"), spark.read.schema(kept).parquet(f"{path}/waiting/batch={max(batches)}")


def keyed_state(stream: DataFrame, key: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """State per key and field as a streaming aggregate; run it in update mode.

    The state is one row per key in the state store; the partial aggregate
    keeps a hot key at one row per task.
    """
    return field_state(stream, key, values, order)


def run_keyed_state(state: DataFrame, replica: ReplicaLog, checkpoint: str) -> None:
    """Writes the changed keys of every trigger to the replica's log.

    The state store provider is set while the query starts, and put back.
    """
    conf, name = state.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKSDB)
    try:
        run_batches(state, lambda batch, batch_id: replica.append_state(batch, batch_id), checkpoint, mode="update")
    finally:
        conf.set(name, before)
