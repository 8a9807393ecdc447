from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideline.functions import casts
from tideline.functions.casts import ColumnMeta
from tideline.operators import schema

from .conftest import column, rows


def value():
    return F.col("v")


@pytest.mark.parametrize(
    ("kind", "given", "expected"),
    [
        ("int", ["1", " 2 ", "+3", "-4", "12.7", "1e3", "2147483648", "", "x"], [1, 2, 3, -4, None, None, None, None, None]),
        ("bigint", ["2147483648", "9223372036854775808", "-1"], [2147483648, None, -1]),
        ("decimal", ["1.5", "1,000.25", "-.5", "1e3", ".", ","], [Decimal("1.5"), Decimal("1000.25"), Decimal("-0.5"), None, None, None]),
        ("decimal(5,2)", ["999.99", "1000"], [Decimal("999.99"), None]),
        ("float", ["1e3", "1,000.5", "-2", "x"], [1000.0, 1000.5, -2.0, None]),
        ("bit", ["true", " FALSE ", "1", "yes"], [True, False, None, None]),
        ("uniqueidentifier", ["{0F8FAD5B-D9CB-469F-A165-70867728950E}", "0f8fad5bd9cb469fa16570867728950e", "0f8fad5b"],
         ["0f8fad5b-d9cb-469f-a165-70867728950e", "0f8fad5b-d9cb-469f-a165-70867728950e", None]),
        ("sql_variant", ["anything"], ["anything"]),
    ],
)
def test_cast_as(spark, kind, given, expected):
    assert column(spark, given, casts.cast_as(value(), kind)) == expected


def test_cast_datetime(spark):
    given = ["0", "1757342915123", "-5", "2024-02-30", "2024-02-29", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00+02:00", "1/31/2024", "bad", None, "9223372036854775807"]
    assert column(spark, given, casts.cast_datetime(value())) == [
        dt.datetime(1970, 1, 1), dt.datetime(2025, 9, 8, 14, 48, 35, 123000), None, None, dt.datetime(2024, 2, 29),
        dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 31), None, None, None,
    ]


def test_cast_datetime_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        given = ["2024-01-01T10:00:00Z", "2024-01-01 10:00:00", "0", "1/31/2024"]
        assert column(spark, given, casts.cast_datetime(value())) == [dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 10), dt.datetime(1970, 1, 1), dt.datetime(2024, 1, 31)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_iso_text(spark):
    assert column(spark, [0, 1757342915123, -1], casts.epoch_ms_to_iso(value()), "bigint") == [
        "1970-01-01T00:00:00.0000000Z", "2025-09-08T14:48:35.1230000Z", "1969-12-31T23:59:59.9990000Z",
    ]


def test_quarantine(spark):
    metas = [ColumnMeta("a", "int", nullable=False), ColumnMeta("b", "nvarchar", max_length=3), ColumnMeta("c", "bigint"), ColumnMeta("d", "datetime")]
    data = [(1, "1", "abc", "5", "bad date"), (2, "", "abcd", "-5", None), (3, "x", "", "y", "9223372036854775807")]
    good, bad = casts.split_quarantine(casts.cast_columns(spark.createDataFrame(data, "k int, a string, b string, c string, d string"), metas, ["k"]))
    assert rows(good) == [(1, 1, "abc", 5, None)]
    assert rows(bad, "k", "errors") == [
        (2, "a: not_null; b: too_long; c: negative_bigint"),
        (3, "a: cannot_convert_to_int; c: cannot_convert_to_bigint; d: date_out_of_range"),
    ]


def test_spark_schema_and_metas():
    fields = [
        {"name": "Id", "type": "id", "length": 18, "nullable": False},
        {"name": "Total__c", "type": "currency"},
        {"name": "At__c", "type": "DateTime"},
        {"name": "Any__c", "type": "anytype"},
        {"name": "Mail", "type": "email"},
        {"name": "Rate", "type": "percent"},
    ]
    built = schema.spark_schema(fields)
    assert [f.dataType.simpleString() for f in built] == ["string", "decimal(19,4)", "timestamp_ntz", "variant", "string", "decimal(5,2)"]
    assert built["Id"].metadata == {"length": 18} and not built["Id"].nullable
    metas = {m.name: (m.data_type, m.max_length) for m in schema.column_metas(fields)}
    assert metas == {"Id": ("nvarchar", 18), "Total__c": ("decimal(19,4)", -1), "At__c": ("datetime", -1), "Any__c": ("sql_variant", -1), "Mail": ("nvarchar", 80), "Rate": ("decimal(5,2)", -1)}
    with pytest.raises(ValueError, match="not supported"):
        schema.spark_schema([{"name": "x", "type": "widget"}])


def test_storage_type_strict(spark):
    df = spark.createDataFrame([("String", 0), ("id", 18), ("multipicklist", 8001), ("combobox", 1)], "t string, n int")
    assert [r[0] for r in df.select(schema.storage_type(F.col("t"), F.col("n"))).collect()] == ["NVARCHAR(MAX)", "NVARCHAR(18)", "NVARCHAR(MAX)", "NVARCHAR(255)"]
    with pytest.raises(Exception, match="not supported"):
        spark.createDataFrame([("widget", 1)], "t string, n int").select(schema.storage_type(F.col("t"), F.col("n"), strict=True)).collect()


def test_default_literal(spark):
    given = ['{"d":"it"}', '{"d":1.50}', '{"d":true}', '{"d":false}', '{"d":null}', "{}", '{"d":[1]}', "bad"]
    assert column(spark, given, schema.default_literal(schema.json_token(value(), "d"))) == ["'it'", "1.5", "1", "0", None, None, "[1]", None]
