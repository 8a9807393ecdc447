"""Positions and neighbours in an order, without one task per group.

A plain window sends all rows of a group to one task.  That is right for
ordinary groups, so they keep it.  Groups above ``hot_rows`` are counted first
and take another road: their rows are range-partitioned by (keys, order), so a
hot group spreads over many tasks, are sorted there and checkpointed; what
crosses a partition border (an offset, a last row) is one row per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .keys import hot_keys, small_side

HOT_ROWS = 5_000_000
_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def range_sorted(df: DataFrame, sort: Sequence[Column], partitions: int | None) -> DataFrame:
    """Rows in global order: ``_part`` is the partition, ``_pos`` the place in it.

    The checkpoint fixes the range borders, so that the count and the rows seen
    later agree even if tasks are run again.  Without ``partitions`` the session's
    shuffle width is used and AQE merges what is small.
    """
    ids = F.monotonically_increasing_id()
    spread = df.repartitionByRange(partitions, *sort) if partitions else df.repartitionByRange(*sort)
    ranged = spread.sortWithinPartitions(*sort).withColumn("_id_in_order", ids)
    fixed = cut_lineage(ranged)
    return fixed.withColumn("_part", F.shiftright("_id_in_order", _POSITION_BITS)).withColumn(
        "_pos", F.col("_id_in_order").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    ).drop("_id_in_order")


def _with_index(ranged: DataFrame) -> DataFrame:
    """Adds ``_index``, the 0-based place in the global order."""
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # Bounded: two longs for each partition, whatever the rows.
    return ranged.join(F.broadcast(offsets), "_part").withColumn("_index", F.col("_offset") + F.col("_pos")).drop("_offset")


def global_row_number(df: DataFrame, order: Sequence[Column], out: str, partitions: int | None = None) -> DataFrame:
    """1-based place of every row in a total order, with no single-task sort."""
    indexed = _with_index(range_sorted(df, order, partitions))
    return indexed.withColumn(out, (F.col("_index") + 1).cast("bigint")).drop("_part", "_pos", "_index")


def indexed_rows(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> tuple[DataFrame, int]:
    """Rows in global order with ``_index`` from 0, partitions in that order too, and how many rows there are."""
    ranged = range_sorted(df, order, partitions)
    return _with_index(ranged), ranged.count()


def _split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    found = hot_keys(df, keys, hot_rows)
    hot = small_side(found.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)]))
    if hot.isEmpty():
        return df, None
    same = [df[k].eqNullSafe(F.col(f"__h{i}")) for i, k in enumerate(keys)]
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def row_number_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    hot_rows: int | None = HOT_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """1-based place of every row inside its group.

    With ``hot_rows`` None no hot group is looked for: right where a group is
    small by its nature, as the lines of one order, and spares a count.
    """
    cold, hot = (df, None) if hot_rows is None else _split_hot(df, keys, hot_rows)
    numbered = cold.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    if hot is None:
        return numbered
    sort = [F.col(k) for k in keys] + list(order)
    indexed = _with_index(range_sorted(hot, sort, partitions))
    starts = indexed.groupBy(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)]).agg(F.min("_index").alias("_start"))
    same = [indexed[k].eqNullSafe(F.col(f"__s{i}")) for i, k in enumerate(keys)]
    placed = indexed.join(small_side(starts), same).withColumn(out, (F.col("_index") - F.col("_start") + 1).cast("bigint"))
    return numbered.unionByName(placed.select(*numbered.columns))


def lag_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    values: Mapping[str, str],
    hot_rows: int = HOT_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """The previous row's values inside each group: ``values`` maps column to new name."""
    cold, hot = _split_hot(df, keys, hot_rows)
    window = Window.partitionBy(*keys).orderBy(*order)
    lagged = cold.select("*", *[F.lag(v).over(window).alias(o) for v, o in values.items()])
    if hot is None:
        return lagged
    ranged = range_sorted(hot, [F.col(k) for k in keys] + list(order), partitions)
    row = F.struct(F.struct(*keys).alias("k"), F.struct(*values).alias("v"))
    inside = Window.partitionBy("_part").orderBy("_pos")
    last = ranged.groupBy("_part").agg(F.max_by(row, "_pos").alias("_last"))
    border = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_border"))  # one row per partition
    near = ranged.withColumn("_near", F.lag(row).over(inside)).join(border, "_part")
    previous = F.when(F.col("_pos") == 0, F.col("_border")).otherwise(F.col("_near"))
    found = near.withColumn("_prev", previous)
    same_group = F.col("_prev.k").eqNullSafe(F.struct(*keys))
    result = found.select(*df.columns, *[F.when(same_group, F.col(f"_prev.v.{v}")).alias(o) for v, o in values.items()])
    return lagged.unionByName(result)
