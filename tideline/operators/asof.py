"""As-of join: each event meets the row of its key that was in force at its time.

Events and rows go into one range-partitioned order by (key, time), so that the
events of a key with a third of all events lie in many partitions.  Inside a
partition the last row is carried on; what a partition begins with is the last
row of the partitions before it, one row each.  Neither side is broadcast and no
key is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import range_sorted


def as_of_join(events: DataFrame, rows: DataFrame, on: Sequence[str], event_time: str, row_time: str, values: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The events with ``values`` and ``in_force_since`` of the last row of their key not after them.

    NULLs where there is none: no row so early, or a NULL key or time.  Of rows
    with one key and time the one with the greatest values counts.  NULL keys do
    not meet.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("_event")
    row = F.struct(F.col(row_time).alias("since"), *[F.col(v) for v in values])
    key = [F.col(k).alias(f"_k{i}") for i, k in enumerate(on)]
    usable = F.col(row_time).isNotNull()
    for k in on:
        usable = usable & F.col(k).isNotNull()
    right = rows.filter(usable).groupBy(*key, F.col(row_time).alias("_t")).agg(F.max(row).alias("_row"))
    left = events.select(*key, F.col(event_time).alias("_t"), kept)
    both = right.withColumn("_event", F.lit(None).cast(left.schema["_event"].dataType)).unionByName(left.withColumn("_row", F.lit(None).cast(right.schema["_row"].dataType)))
    names = [f"_k{i}" for i in range(len(on))]
    # A row comes before the events of its time.
    ranged = range_sorted(both, [*[F.col(n) for n in names], F.col("_t"), F.col("_row").isNull()], partitions)
    carried = F.when(F.col("_row").isNotNull(), F.struct(*names, "_row"))
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    last = ranged.groupBy("_part").agg(F.max_by(carried, F.when(F.col("_row").isNotNull(), F.col("_pos"))).alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    border = last.select("_part", F.last("_last", ignorenulls=True).over(before).alias("_border"))
    near = ranged.withColumn("_near", F.last(carried, ignorenulls=True).over(inside)).join(border, "_part")
    met = near.filter(F.col("_event").isNotNull()).withColumn("_found", F.coalesce("_near", "_border"))
    same = F.col("_t").isNotNull()
    for n in names:
        same = same & F.coalesce(F.col(f"_found.{n}") == F.col(n), F.lit(False))
    value = lambda name: F.when(same, F.col(f"_found._row.{name}"))
    return met.select("_event.*", value("since").alias("in_force_since"), *[value(v).alias(v) for v in values])
