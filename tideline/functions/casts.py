"""Typed casts of text values with the reason for each refusal.

The accepted text is narrower than Spark's own casts, so each cast is guarded
by a pattern.  Dates that cannot be read become NULL without a reason; every
other refusal names one, for the quarantine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .once import computed_once

NOT_NULL = "not_null"
TOO_LONG = "too_long"
NEGATIVE = "negative_bigint"
BAD_VALUE = "cannot_convert_to_"
OUT_OF_RANGE = "date_out_of_range"

# The text forms each type accepts.
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
EPOCH_TEXT = r"^\s*(\+?[0-9]+|-0+)\s*$"
DECIMAL_TEXT = r"^\s*[+-]?(?=[0-9,]*\.?[0-9])([0-9][0-9,]*)?(\.[0-9]*)?\s*$"
DOUBLE_TEXT = r"^\s*[+-]?(?=[0-9,]*\.?[0-9])([0-9][0-9,]*)?(\.[0-9]*)?([eE][+-]?[0-9]+)?\s*$"
BOOLEAN_TEXT = r"(?i)^\s*(true|false)\s*$"
UUID_TEXT = r"(?i)^\s*(\{[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\}|\([0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\)|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{32})\s*$"
ZONED_TEXT = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"
LAST_EPOCH_MS = 253402300799999  # 9999-12-31T23:59:59.999


@dataclass(frozen=True)
class ColumnMeta:
    """What the catalog says of one replica column."""

    name: str
    data_type: str
    max_length: int = -1
    nullable: bool = True


def is_empty(value: Column) -> Column:
    return value.isNull() | (value == "")


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def not_null_error(value: Column, nullable: Column | bool) -> Column:
    """An empty text counts as missing, for text columns too."""
    allowed = F.lit(nullable) if isinstance(nullable, bool) else nullable
    return F.when(is_empty(value) & ~allowed, F.lit(NOT_NULL))


def length_error(value: Column, max_length: Column | int) -> Column:
    limit = F.lit(max_length) if isinstance(max_length, int) else max_length
    return F.when((limit > 0) & (F.length(value) > limit), F.lit(TOO_LONG))


def negative_error(value: Column) -> Column:
    return F.when(value < 0, F.lit(NEGATIVE))


def epoch_ms_to_wall(ms: Column) -> Column:
    """UTC wall time of an epoch in milliseconds."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.floor(ms / F.lit(1000))
    rest = ms - seconds * 1000
    return start + F.make_dt_interval(
        F.floor(seconds / 86400).cast("int"),
        F.lit(0),
        F.lit(0),
        (F.pmod(seconds, F.lit(86400)) + rest / F.lit(1000)).cast("decimal(18,6)"),
    )


def epoch_ms_to_iso(ms: Column) -> Column:
    """The same instant as ISO-8601 text with seven fraction digits."""
    return F.date_format(epoch_ms_to_wall(ms), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS'Z'")


def _epoch(value: Column) -> Column:
    return F.when(value.rlike(EPOCH_TEXT), F.trim(value).try_cast("bigint"))


def cast_datetime(value: Column) -> Column:
    """Epoch milliseconds, else date text, else NULL; always UTC wall time."""
    ms = _epoch(value)
    zoned = F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.try_cast("timestamp").cast("timestamp_ntz"))
    text = F.when(F.trim(value).rlike(ZONED_TEXT), zoned).otherwise(value.try_cast("timestamp_ntz"))
    slashed = F.try_to_timestamp(F.trim(value), F.lit("M/d/yyyy[ H:mm[:ss]]")).cast("timestamp_ntz")
    dated = F.when(value.rlike(r"^\s*[0-9]{1,2}/"), slashed).when(~value.rlike(INTEGER_TEXT), text)
    in_range = ms.between(0, LAST_EPOCH_MS)
    return F.when(ms.isNotNull(), F.when(in_range, epoch_ms_to_wall(F.when(in_range, ms)))).otherwise(dated)


def _plain_number(value: Column) -> Column:
    return F.replace(F.trim(value), F.lit(","), F.lit(""))


def _guarded(value: Column, pattern: str, cast: Column) -> Column:
    return F.when(value.rlike(pattern), cast)


def cast_as(value: Column, data_type: str) -> Column:
    """``value`` as ``data_type``, NULL where the text is not of that type."""
    kind = data_type.lower()
    base = kind.split("(")[0]
    if base == "int":
        return _guarded(value, INTEGER_TEXT, F.trim(value).try_cast("int"))
    if base == "bigint":
        return _guarded(value, INTEGER_TEXT, F.trim(value).try_cast("bigint"))
    if base in ("decimal", "numeric"):
        target = "decimal(19,4)" if kind == base else kind.replace("numeric", "decimal")
        return _guarded(value, DECIMAL_TEXT, _plain_number(value).try_cast(target))
    if base == "float":
        return _guarded(value, DOUBLE_TEXT, _plain_number(value).try_cast("double"))
    if base == "bit":
        return _guarded(value, BOOLEAN_TEXT, F.lower(F.trim(value)) == "true")
    if base in ("date", "datetime"):
        return cast_datetime(value)
    if base == "uniqueidentifier":
        digits = F.regexp_replace(F.lower(value), "[^0-9a-f]", "")
        return _guarded(value, UUID_TEXT, F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    return value


def cast_error(value: Column, meta: ColumnMeta, typed: Column | None = None) -> Column:
    """Why ``value`` may not enter the column, or NULL; ``typed`` is its cast if known."""
    base = meta.data_type.lower().split("(")[0]
    checks = [not_null_error(value, meta.nullable)]
    if base in ("varchar", "nvarchar"):
        checks.append(length_error(value, meta.max_length))
    elif base in ("date", "datetime"):
        digits = value.rlike(EPOCH_TEXT)
        checks.append(F.when(digits & (F.trim(value).try_cast("bigint") > LAST_EPOCH_MS), F.lit(OUT_OF_RANGE)))
    elif base in ("int", "bigint", "decimal", "numeric", "float", "bit", "uniqueidentifier"):
        cast = cast_as(value, meta.data_type) if typed is None else typed
        checks.append(F.when(~is_empty(value) & cast.isNull(), F.lit(BAD_VALUE + base)))
        if base == "bigint":
            checks.append(negative_error(cast))
    return F.coalesce(*checks)


def cast_columns(df: DataFrame, metas: list[ColumnMeta], keep: list[str] = ()) -> DataFrame:
    """Cast every described column; ``errors`` names each refused column and why.

    Each value is cast once: the reasons look at the result of the cast.
    """
    typed = [cast_as(empty_to_null(F.col(m.name)), m.data_type).alias(f"_typed_{m.name}") for m in metas]
    both = df.select(*keep, *[F.col(m.name) for m in metas], *typed)
    # concat() with a NULL is NULL and concat_ws() skips it: only refusals are listed.
    reasons = [F.concat(F.lit(f"{m.name}: "), cast_error(F.col(m.name), m, F.col(f"_typed_{m.name}"))) for m in metas]
    checked = computed_once(both, "errors", F.nullif(F.concat_ws("; ", *reasons), F.lit("")))
    return checked.select(*keep, *[F.col(f"_typed_{m.name}").alias(m.name) for m in metas], "errors")


def split_quarantine(cast: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows fit to write, and the refused ones with their reasons."""
    return cast.filter(F.col("errors").isNull()).drop("errors"), cast.filter(F.col("errors").isNotNull())
