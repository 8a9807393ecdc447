"""From decoded change events to field-level deltas.

Decoded events carry ``replay_id, commit_ts, entity, record_ids, change_type,
changed_fields`` and one nullable column per object field.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import INTEGER_TEXT, epoch_ms_to_iso
from ..functions.text import UNKNOWN, change_type_of
from .keys import small_side

UPSERTS = ("INSERT", "CREATE", "UPDATE")
DELETES = ("DELETE",)
ID_FIELD = "Id"

NO_HEADER = "no_header"
NO_RECORD = "no_record_id"
DECODE_FAILED = "decode_failed"
UNKNOWN_CHANGE = "unknown_change_type"
NO_COLUMN = "no_matching_column"


def header_fields(df: DataFrame, header: str = "ChangeEventHeader") -> DataFrame:
    """Record ids, changed fields and entity out of the event header."""
    none = F.array().cast("array<string>")
    return df.select(
        "*",
        F.coalesce(F.col(f"{header}.entityName"), F.lit(UNKNOWN)).alias("entity"),
        F.coalesce(F.col(f"{header}.recordIds"), none).alias("record_ids"),
        F.coalesce(F.col(f"{header}.changedFields"), none).alias("changed_fields"),
    )


def with_change_type(df: DataFrame, header_text: str, out: str = "change_type") -> DataFrame:
    return df.withColumn(out, change_type_of(F.col(header_text)))


def fan_out(df: DataFrame, first_only: bool = False) -> DataFrame:
    """One row per record id of an event, or only the first id for parity.

    An event without any id is a dead letter (``no_record_id``) before this step.
    """
    if first_only:
        return df.withColumn("record_id", F.try_element_at("record_ids", F.lit(1))).filter(F.col("record_id").isNotNull())
    return df.withColumn("record_id", F.explode(F.array_compact("record_ids")))


def delta_long(df: DataFrame, fields: Sequence[str], keys: Sequence[str], types: Mapping[str, str] | None = None) -> DataFrame:
    """One (field_name, field_value) row per field that has a value."""
    tags = types or {}
    text = df.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields])
    pairs = text.unpivot(list(keys), list(fields), "field_name", "field_value").filter(F.col("field_value").isNotNull())
    tag = F.lit(UNKNOWN)
    for field, kind in tags.items():
        tag = F.when(F.col("field_name") == field, F.lit(kind)).otherwise(tag)
    return pairs.withColumn("data_type", tag)


def keep_fields(delta: DataFrame, filters: DataFrame, topic: str = "topic", field: str = "field_name") -> DataFrame:
    """Keep the listed fields of a topic; a topic without a list keeps all.

    ``filters`` is ``(topic, fields array)``, one row per topic.
    """
    lists = small_side(filters.select(F.col("topic").alias("_topic"), F.col("fields").alias("_fields")))
    wanted = F.col("_fields").isNull() | (F.size("_fields") == 0) | F.array_contains(F.col("_fields"), F.col(field))
    joined = delta.join(lists, delta[topic] == F.col("_topic"), "left")
    return joined.filter(F.coalesce(wanted, F.lit(True))).select(*delta.columns)


def with_id_rows(delta: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the Id row of each event: its first record id."""
    ids = fan_out(events, first_only=True).select(
        *keys,
        F.lit(ID_FIELD).alias("field_name"),
        F.col("record_id").alias("field_value"),
        F.lit(ID_FIELD).alias("data_type"),
    )
    return delta.unionByName(ids)


def delete_delta(df: DataFrame) -> DataFrame:
    """Entity and record id of every delete."""
    return fan_out(df.filter(F.upper("change_type").isin(*DELETES))).select("replay_id", "entity", "record_id")


def delta_value(value: Column, data_type: Column) -> Column:
    """A DateTime given as a number becomes ISO-8601 text; the rest stays."""
    number = F.when(value.rlike(INTEGER_TEXT), F.trim(value).try_cast("bigint"))
    in_range = number.between(-62135596800000, 253402300799999)  # years 1 to 9999
    return F.when((data_type == "DateTime") & in_range, epoch_ms_to_iso(F.when(in_range, number))).otherwise(value)


def long_to_wide(delta: DataFrame, keys: Sequence[str], fields: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """A column per known field; the later of two values wins.

    The field list comes from the describe table, so no job runs to find it,
    and the aggregate combines on the map side.
    """
    value = delta_value(F.col("field_value"), F.col("data_type"))
    place = F.struct(*sequence)
    latest = [F.max(F.when(F.col("field_name") == f, F.struct(place.alias("o"), value.alias("v")))).alias(f) for f in fields]
    wide = delta.groupBy(*keys).agg(*latest)
    return wide.select(*keys, *[F.col(f"{f}.v").alias(f) for f in fields])


def route(df: DataFrame) -> DataFrame:
    """Adds ``route``: upsert, delete, or NULL for a change type nobody knows."""
    kind = F.upper("change_type")
    return df.withColumn("route", F.when(kind.isin(*UPSERTS), F.lit("upsert")).when(kind.isin(*DELETES), F.lit("delete")))


def dead_letter_reason(header: Column, decoded: Column, change_type: Column, matching_fields: Column, record_ids: Column) -> Column:
    """Why an event cannot be applied, or NULL."""
    known = F.upper(change_type).isin(*UPSERTS, *DELETES)
    is_delete = F.upper(change_type).isin(*DELETES)
    return (
        F.when(~F.coalesce(decoded, F.lit(False)), F.lit(DECODE_FAILED))
        .when(header.isNull(), F.lit(NO_HEADER))
        .when(F.coalesce(F.size(F.array_compact(record_ids)), F.lit(0)) == 0, F.lit(NO_RECORD))
        .when(~F.coalesce(known, F.lit(False)), F.lit(UNKNOWN_CHANGE))
        .when(~is_delete & (matching_fields == 0), F.lit(NO_COLUMN))
    )


def split_dead_letters(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def audit(df: DataFrame) -> DataFrame:
    """Change type, changed fields and record ids of each event as text."""
    return df.select(
        "replay_id",
        "change_type",
        F.array_join("changed_fields", ",").alias("changed_fields"),
        F.array_join("record_ids", ",").alias("record_ids"),
    )
