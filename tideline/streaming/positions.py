"""Which replay ids of each topic have been applied, as ranges with their gaps.

The ranges are written with the batch that applied them, under its number, from
those of the batch before; a batch that runs again writes the same.  Ids that
touch are one range, so a feed without losses is one row per topic, however long
it runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..files import remove, subfolders

RANGES = "topic string, low bigint, high bigint"
BLOCK_BITS = 16


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges that touch or overlap as one."""
    order = Window.partitionBy(*keys).orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = ranges.withColumn("_new", F.when(F.col("low") > reach + 1, 1).otherwise(0))
    grouped = begins.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_group").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_group")


def ranges_of(ids: DataFrame, topic: str = "topic", replay_id: str = "replay_id") -> DataFrame:
    """(topic, low, high) of the ids: first inside blocks of 65,536, so that no topic's ids meet in one task, then across."""
    known = ids.select(F.col(topic).alias("topic"), F.col(replay_id).alias("low")).filter("topic is not null and low is not null").distinct()
    single = known.select("topic", F.shiftright("low", BLOCK_BITS).alias("_block"), "low", F.col("low").alias("high"))
    return merge_ranges(merge_ranges(single, ["topic", "_block"]).drop("_block"), ["topic"])


def gaps_of(ranges: DataFrame) -> DataFrame:
    """(topic, low, high) of the ids missing between a topic's ranges."""
    order = Window.partitionBy("topic").orderBy("low")
    before = ranges.withColumn("_end", F.lag("high").over(order))
    return before.filter(F.col("_end").isNotNull()).select("topic", (F.col("_end") + 1).alias("low"), (F.col("low") - 1).alias("high"))


@dataclass(frozen=True)
class ReplayPositions:
    """The applied ranges after every batch, in ``path``; two batches are kept."""

    spark: SparkSession
    path: str

    def after(self, batch_id: int) -> DataFrame:
        """The ranges that the last batch up to this one left."""
        found = [b for b in subfolders(self.spark, self.path, "batch", committed=True) if b <= batch_id]
        return self.spark.read.schema(RANGES).parquet(f"{self.path}/batch={max(found)}") if found else self.spark.createDataFrame([], RANGES)

    def advance(self, batch: DataFrame, batch_id: int, topic: str = "topic", replay_id: str = "replay_id") -> None:
        """Adds the ids of a batch; call it where the batch is applied."""
        every = self.after(batch_id - 1).unionByName(ranges_of(batch, topic, replay_id))
        merge_ranges(every, ["topic"]).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        for old in subfolders(self.spark, self.path, "batch"):
            if old < batch_id - 1:
                remove(self.spark, f"{self.path}/batch={old}")

    def ranges(self) -> DataFrame:
        return self.after(1 << 62)

    def gaps(self) -> DataFrame:
        return gaps_of(self.ranges())
