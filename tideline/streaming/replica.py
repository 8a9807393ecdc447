"""A replica kept as a log of batch states and a merged base in buckets.

Each micro-batch writes its state per record under its own batch number, so a
batch that runs twice writes the same files.  The base is dealt into buckets by a
hash of the key, each one version of a folder.  ``compact`` merges the batches
since the last one into the buckets they touch and leaves the others alone; the
manifest, written last and in one file, names the live version of every bucket.
What no manifest names does not count, so a torn compaction loses nothing.
``reclaim`` removes what neither the last manifest nor the one before needs: a
reader that has begun on the one before can finish.

``bootstrap`` makes a snapshot the first base: records as they were before the
feed.  Changes merge by their order, so events that the snapshot already holds
change nothing.  Deletes stay in the state, so a late older change cannot bring a
record back, until a low-water mark says that none will come.  All of it is in files of the shared folder; nothing depends on one
executor.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..files import remove, subfolders
from ..operators.apply import EVENT_ORDER, base_as_changes, field_state, finish_fields, finish_images, image_state, merge_into, merge_states
from ..operators.delta import DELETES

BUCKETS = 32
SNAPSHOT = -1  # version and manifest number of a bootstrap: before every batch
BEGINNING = dt.datetime(1, 1, 1)


@dataclass(frozen=True)
class ReplicaLog:
    """``schema`` holds the key and value columns of the replica.

    Events carry changed fields, and each field keeps its own last value.  With
    ``partial`` False each event carries its whole image.  ``partition_by`` names
    key columns the files are laid out by, as the entity of a feed of many.
    ``buckets`` is fixed for the life of a replica; one should hold some hundred
    megabytes, as it is rewritten whole when one of its records changes.
    """

    spark: SparkSession
    path: str
    key: Sequence[str]
    schema: T.StructType
    partial: bool = True
    partition_by: Sequence[str] = ()
    buckets: int = BUCKETS

    @property
    def values(self) -> list[str]:
        return [f.name for f in self.schema.fields if f.name not in self.key]

    def _state_of(self, events: DataFrame) -> DataFrame:
        build = field_state if self.partial else image_state
        return build(events, self.key, self.values)

    def _state_schema(self) -> T.StructType:
        order = [T.StructField(n, t) for n, t in zip(EVENT_ORDER, (T.TimestampNTZType(), T.LongType()))]
        kind = [T.StructField("change_type", T.StringType()), T.StructField("changed_fields", T.ArrayType(T.StringType()))]
        events = self.spark.createDataFrame([], T.StructType([*self.schema.fields, *order, *kind]))
        return self._state_of(events).schema

    def _with_bucket(self, state: DataFrame) -> DataFrame:
        return state.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    # Reading -----------------------------------------------------------------------

    def _manifest(self) -> tuple[int | None, Mapping[int, int]]:
        """Last batch of the newest manifest, and the live version of each bucket that holds a record."""
        numbers = subfolders(self.spark, f"{self.path}/manifest", "at", committed=True)
        if not numbers:
            return None, {}
        live = self.spark.read.schema("bucket int, version bigint").parquet(f"{self.path}/manifest/at={max(numbers)}")
        # Bounded by the number of buckets.
        row = live.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "version"))).alias("m")).first()
        return max(numbers), row["m"]

    def _base(self, live: Mapping[int, int]) -> DataFrame:
        schema = self._state_schema().add("bucket", T.IntegerType())
        if not live:
            return self.spark.createDataFrame([], schema)
        # Named one by one: what an older or torn compaction left behind is not even listed.
        paths = [f"{self.path}/base/version={version}/bucket={bucket}" for bucket, version in sorted(live.items())]
        parts = T.StructType([*schema.fields, T.StructField("version", T.LongType())])
        return self.spark.read.schema(parts).option("basePath", f"{self.path}/base").parquet(*paths).drop("version")

    def _batches(self, after: int | None, before: int | None) -> list[int]:
        found = subfolders(self.spark, f"{self.path}/changes", "batch")
        return sorted(b for b in found if (after is None or b > after) and (before is None or b < before))

    def _later(self, after: int | None, before: int | None = None) -> DataFrame:
        """State of the batches after a manifest."""
        found = self._batches(after, before)
        schema = self._state_schema()
        if not found:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/changes/batch={b}" for b in found]
        batches = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{self.path}/changes")
        return merge_states(batches.parquet(*paths).drop("batch"), self.key)

    def folded(self, before: int | None = None) -> DataFrame:
        """State of every record, deleted ones included; with ``before`` as it was before that batch."""
        number, live = self._manifest()
        later = self._later(number, before)
        if not live:
            return later
        return merge_into(self._base(live).drop("bucket"), later, self.key)

    def current(self) -> DataFrame:
        """The replica: the records that exist, in the columns of the schema."""
        finish = finish_fields if self.partial else finish_images
        return finish(self.folded(), self.key, self.values).select(*[f.name for f in self.schema.fields])

    # Writing -----------------------------------------------------------------------

    def append(self, events: DataFrame, batch_id: int) -> None:
        """State of one batch; an empty batch writes nothing that counts."""
        self.append_state(self._state_of(events), batch_id)

    def append_state(self, state: DataFrame, batch_id: int) -> None:
        """A batch that is a state already, as from a streaming aggregate."""
        state.write.mode("overwrite").partitionBy(*self.partition_by).parquet(f"{self.path}/changes/batch={batch_id}")

    def _write_base(self, state: DataFrame, version: int) -> Mapping[int, int]:
        """Writes whole buckets, each in one task, as one version; returns which."""
        folder = f"{self.path}/base/version={version}"
        state.write.mode("overwrite").partitionBy("bucket", *self.partition_by).parquet(folder)
        return {bucket: version for bucket in subfolders(self.spark, folder, "bucket")}

    def _publish(self, live: Mapping[int, int], number: int) -> None:
        rows = self.spark.createDataFrame(sorted(live.items()), "bucket int, version bigint")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/at={number}")

    def bootstrap(self, image: DataFrame, as_of: dt.datetime = BEGINNING) -> None:
        """Makes a snapshot the base of a replica that has none.

        ``image`` has the key and value columns, one row per record; ``as_of`` is the
        time it was read.  Events up to then that arrive all the same have no effect.
        A bootstrap that broke off is repeated; batches may have been written before.
        """
        if self._manifest()[0] is not None:
            raise ValueError("the replica has a base; its records come from the feed")
        order = {"commit_ts": F.lit(as_of).cast("timestamp_ntz"), "replay_id": F.lit(-(2**63)).cast("bigint")}
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        state = self._state_of(base_as_changes(image.select(*columns), order))
        self._publish(self._write_base(self._with_bucket(state).repartition("bucket"), SNAPSHOT), SNAPSHOT)

    def _without_old_deletes(self, state: DataFrame, low_water: dt.datetime) -> DataFrame:
        """State without deleted records (and updates that never met a create) whose last change is before the mark."""
        mark = F.lit(low_water).cast("timestamp_ntz")
        at = F.col("_at.commit_ts") if self.partial else F.col("_last.commit_ts")
        if self.partial:
            dead = F.col("_reset").isNull() | F.col("_reset.kind").isin(*DELETES)
        else:
            dead = F.upper("_last.change_type").isin(*DELETES)
        return state.filter(~(dead & (at < mark)))

    def compact(self, before: int | None = None, low_water: dt.datetime | None = None) -> None:
        """Merges the batches since the last compaction (only those before a batch) into the buckets they touch.

        With ``low_water`` no change older than it is expected any more: in the
        touched buckets, the state of records deleted before it ends.
        """
        number, live = self._manifest()
        batches = self._batches(number, before)
        if not batches:
            return
        later = self._with_bucket(self._later(number, before))
        # Bounded by the number of buckets.
        touched = later.agg(F.collect_set("bucket").alias("b")).first()["b"]
        if touched:
            held = self._base({b: v for b, v in live.items() if b in touched})
            # Dealt by bucket once: that serves the merge by (bucket, key) and the writing of whole buckets.
            merged = merge_states(held.unionByName(later).repartition("bucket"), ["bucket", *self.key])
            merged = merged if low_water is None else self._without_old_deletes(merged, low_water)
            kept = {b: v for b, v in live.items() if b not in touched}  # a touched bucket may have become empty
            live = {**kept, **self._write_base(merged, max(batches))}
        # Readers use the new buckets from here on.
        self._publish(live, max(batches))
        self.reclaim()

    def reclaim(self) -> None:
        """Removes folders that neither the newest manifest nor the one before it needs."""
        numbers = sorted(subfolders(self.spark, f"{self.path}/manifest", "at", committed=True))[-2:]
        if not numbers:
            return
        needed = set()
        for number in numbers:
            live = self.spark.read.schema("bucket int, version bigint").parquet(f"{self.path}/manifest/at={number}")
            row = live.agg(F.collect_set(F.struct("version", "bucket")).alias("v")).first()  # bounded by the number of buckets
            needed |= {(v["version"], v["bucket"]) for v in row["v"]}
        for old in subfolders(self.spark, f"{self.path}/manifest", "at"):
            if old not in numbers:
                remove(self.spark, f"{self.path}/manifest/at={old}")
        for batch in subfolders(self.spark, f"{self.path}/changes", "batch"):
            if batch <= numbers[0]:
                remove(self.spark, f"{self.path}/changes/batch={batch}")
        for version in subfolders(self.spark, f"{self.path}/base", "version"):
            folder = f"{self.path}/base/version={version}"
            held = subfolders(self.spark, folder, "bucket")
            spare = [b for b in held if (version, b) not in needed]
            if len(spare) == len(held):
                remove(self.spark, folder)
            else:
                for bucket in spare:
                    remove(self.spark, f"{folder}/bucket={bucket}")
