"""Costly expressions evaluated once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Adds a column whose expression is not copied into later filters.

    The optimizer pushes a filter on a projected column below the projection and
    copies the expression into it, so a parse would run once for the filter and
    again for the result.  A generator's output is not copied; exploding an
    array of one keeps every row, NULL results too.
    """
    return df.select("*", F.explode(F.array(expression)).alias(name))
