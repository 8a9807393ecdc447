"""Membership by key.

The looked-up side is reduced to its distinct keys before any shuffle, so a key
that holds many of its rows costs one row.  The kept side is never grouped; AQE
splits its hot partitions.  Spark broadcasts the key side by its own measure;
only ``small_side`` asks for it, after counting the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


SMALL_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A lookup table fixed and counted: marked for broadcast if it is small.

    For keys with few values, such as topics and schemas: a shuffle on them would
    send all events to a few tasks, and a stream has no AQE to split those.  A
    larger table has many keys and is joined by shuffle.
    """
    fixed = cut_lineage(df)
    return F.broadcast(fixed) if fixed.count() <= max_rows else fixed


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def _membership(left: DataFrame, right: DataFrame, on: Sequence[str], right_on: Sequence[str], how: str, null_safe: bool) -> DataFrame:
    probe = right.select(*[F.col(r).alias(f"__k{i}") for i, r in enumerate(right_on)]).distinct()
    condition: Column | None = None
    for i, name in enumerate(on):
        match = left[name].eqNullSafe(F.col(f"__k{i}")) if null_safe else left[name] == F.col(f"__k{i}")
        condition = match if condition is None else condition & match
    return left.join(probe, condition, how)


def keep_matching(left: DataFrame, right: DataFrame, on: Sequence[str], right_on: Sequence[str] | None = None, null_safe: bool = False) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return _membership(left, right, on, right_on or on, "left_semi", null_safe)


def drop_matching(left: DataFrame, right: DataFrame, on: Sequence[str], right_on: Sequence[str] | None = None, null_safe: bool = False) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return _membership(left, right, on, right_on or on, "left_anti", null_safe)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows; at most total/hot_rows of them exist."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).select(*keys)
