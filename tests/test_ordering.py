"""Hot groups take another road; both must give what a plain window gives."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.operators import keys, ordering, registry, shape

from .conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, one group under a NULL key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise((F.col("id") % 7).cast("string"))
    return spark.range(3000).select(key.alias("k"), F.pmod(F.hash("id"), F.lit(500)).alias("a"), F.col("id").alias("b"), F.when(F.col("id") % 11 != 0, F.col("id")).alias("v"))


def order():
    return [F.col("a"), F.col("b").desc()]


@pytest.mark.parametrize("hot_rows", [10**9, 500, 1])
def test_row_number_within(skewed, hot_rows):
    plain = skewed.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order())).cast("bigint"))
    assert rows(ordering.row_number_within(skewed, ["k"], order(), "n", hot_rows, partitions=5)) == rows(plain)


@pytest.mark.parametrize("hot_rows", [10**9, 500, 1])
def test_lag_within(skewed, hot_rows):
    plain = skewed.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy(*order())))
    assert rows(ordering.lag_within(skewed, ["k"], order(), {"v": "p"}, hot_rows, partitions=5)) == rows(plain)


def test_more_partitions_than_rows(spark):
    few = spark.createDataFrame([(1, 5), (1, 6), (2, 1)], "k int, a int")
    got = ordering.lag_within(few, ["k"], [F.col("a")], {"a": "p"}, hot_rows=0, partitions=20)
    assert rows(got) == [(1, 5, None), (1, 6, 5), (2, 1, None)]


def test_global_row_number(skewed):
    down = [F.col("a").desc(), F.col("b")]
    plain = skewed.withColumn("n", F.row_number().over(Window.orderBy(*down)).cast("bigint"))
    assert rows(ordering.global_row_number(skewed, down, "n", partitions=6)) == rows(plain)


def test_identity_column(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "name string")
    assert rows(shape.add_identity(df, [F.col("name")], "Id", seed=10, step=-2)) == [("a", 10), ("b", 8), ("c", 6)]
    with pytest.raises(ValueError, match="already exists"):
        shape.add_identity(df, [F.col("name")], "NAME")


def test_symmetric_difference_is_symmetric_in_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    one, two = registry.symmetric_difference(a, b, "k"), registry.symmetric_difference(b, a, "k")
    assert rows(one) == [(1, "x"), (1, "x"), (3, "w"), (None, "n")]
    assert rows(one, "k") == rows(two, "k")
    assert rows(registry.symmetric_difference(a, spark.createDataFrame([(None, "m")], "k int, v string"), "k"), "k") == [(1,), (1,), (2,)]


def test_membership_with_empty_and_null_keys(spark):
    left = spark.createDataFrame([(1,), (None,)], "k int")
    empty = spark.createDataFrame([], "k int")
    assert rows(keys.drop_matching(left, empty, ["k"])) == [(1,), (None,)]
    assert rows(keys.keep_matching(left, empty, ["k"])) == []
    nulls = spark.createDataFrame([(None,)], "k int")
    assert rows(keys.drop_matching(left, nulls, ["k"])) == [(1,), (None,)]
    assert rows(keys.drop_matching(left, nulls, ["k"], null_safe=True)) == [(1,)]
