"""Applying change events to replicas.

Order is (commit time, replay id) and the last change wins.  The net effect of
many events on one record is one aggregate that combines on the map side: a hot
record costs a row per task, not a sorted group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .delta import DELETES
from .keys import drop_matching

EVENT_ORDER = ("commit_ts", "replay_id")
RESETS = ("INSERT", "CREATE", "DELETE")


# A state frame has one row per key and columns that merge by max(): each holds a
# struct led by the order of the change that set it.  Merging is associative and
# idempotent, so states of batches can be merged in any order, and repeatedly.


def image_state(events: DataFrame, key: Sequence[str], values: Sequence[str], order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """State of whole images: the last event of each record."""
    # The order leads the struct, so max() is "last by order".  Structs are not
    # hash-aggregated, but the sort aggregate combines before the shuffle too.
    return events.groupBy(*key).agg(F.max(F.struct(*order, "change_type", *values)).alias("_last"))


def finish_images(state: DataFrame, key: Sequence[str], values: Sequence[str], order: Sequence[str] = EVENT_ORDER, keep_deleted: bool = False) -> DataFrame:
    rows = state.select(*key, *[F.col(f"_last.{c}").alias(c) for c in (*order, "change_type", *values)])
    return rows if keep_deleted else rows.filter(~F.upper("change_type").isin(*DELETES))


def field_state(changes: DataFrame, key: Sequence[str], fields: Sequence[str], order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """State of partial updates: the last reset, and the last setting of each field."""
    if "changed_fields" not in changes.columns:
        raise ValueError("changes without changed_fields carry whole images: image_state, ReplicaLog(partial=False)")
    at = F.struct(*order)
    kind = F.upper("change_type")
    resets = kind.isin(*RESETS)
    deletes = kind.isin(*DELETES)

    def touched(field: str) -> Column:
        return ~deletes & (resets | F.array_contains("changed_fields", field))

    return changes.groupBy(*key).agg(
        F.max(at).alias("_at"),
        F.max(F.when(resets, F.struct(at.alias("at"), kind.alias("kind")))).alias("_reset"),
        *[F.max(F.when(touched(f), F.struct(at.alias("at"), F.col(f).alias("v")))).alias(f"_f_{f}") for f in fields],
    )


def finish_fields(state: DataFrame, key: Sequence[str], fields: Sequence[str], order: Sequence[str] = EVENT_ORDER, keep_deleted: bool = False) -> DataFrame:
    """A field counts when it was set at or after the last reset."""
    gone = F.col("_reset").isNull() | F.col("_reset.kind").isin(*DELETES)
    valid = [F.when(~gone & (F.col(f"_f_{f}.at") >= F.col("_reset.at")), F.col(f"_f_{f}.v")).alias(f) for f in fields]
    result = state.select(*key, *[F.col(f"_at.{o}").alias(o) for o in order], gone.alias("is_deleted"), *valid)
    return result if keep_deleted else result.filter(~F.col("is_deleted")).drop("is_deleted")


def merge_states(states: DataFrame, key: Sequence[str]) -> DataFrame:
    """States of several batches as one."""
    return states.groupBy(*key).agg(*[F.max(c).alias(c) for c in states.columns if c not in key])


def merge_into(base: DataFrame, later: DataFrame, key: Sequence[str]) -> DataFrame:
    """Merges few later states into a large base that has one row per key.

    The base is neither shuffled nor sorted while Spark can broadcast the later
    states; keys new to the base are found through the few that are not.
    """
    columns = [c for c in base.columns if c not in key]
    new = later.select(*key, *[F.col(c).alias(f"_new{c}") for c in columns])
    kept = base.join(new, list(key), "left").select(*key, *[F.greatest(c, f"_new{c}").alias(c) for c in columns])
    known = base.join(later.select(*key), list(key), "left_semi").select(*key)
    return kept.unionByName(later.join(known, list(key), "left_anti"))


def latest_state(
    events: DataFrame,
    key: Sequence[str],
    values: Sequence[str],
    order: Sequence[str] = EVENT_ORDER,
    keep_deleted: bool = False,
) -> DataFrame:
    """The last event of each record as its image; records whose last event deletes are gone.

    Only for events that carry whole images, as after a lookup by id.  Events
    with changed fields are folded by field: ``fold_changes``.
    """
    return finish_images(image_state(events, key, values, order), key, values, order, keep_deleted)


def fold_changes(
    changes: DataFrame,
    key: Sequence[str],
    fields: Sequence[str],
    order: Sequence[str] = EVENT_ORDER,
    keep_deleted: bool = False,
) -> DataFrame:
    """Net effect of partial updates, column by column.

    Create and delete reset a record; an update sets only its changed fields,
    an explicit NULL among them too.  Updates to a record that does not exist
    have no effect.  ``changes`` has ``change_type``, ``changed_fields`` and the
    field columns.
    """
    return finish_fields(field_state(changes, key, fields, order), key, fields, order, keep_deleted)


def base_as_changes(base: DataFrame, order: dict[str, Column]) -> DataFrame:
    """A replica image as create events older than every change."""
    return base.select(
        "*", *[c.alias(n) for n, c in order.items()], F.lit("CREATE").alias("change_type"), F.array().cast("array<string>").alias("changed_fields")
    )


def create_missing(replica: DataFrame, image: DataFrame, creates: DataFrame, key: str) -> DataFrame:
    """Full images of created records that the replica does not hold yet."""
    wanted = creates.select(key).distinct()
    absent = drop_matching(wanted, replica, [key])
    return image.join(absent, key, "left_semi")


def partial_update(replica: DataFrame, updates: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Set the changed columns of records that exist; ``updates`` is one row per key.

    An update row carries ``changed_fields`` and new values; columns of the
    replica that no update names stay as they are, the key always does.
    """
    new = updates.select(F.col(key).alias("_key"), "changed_fields", *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = replica.join(new, replica[key] == F.col("_key"), "left")
    changed = {f: F.coalesce(F.array_contains("changed_fields", f), F.lit(False)) for f in fields}
    columns = [
        F.when(changed[c], F.col(f"_new_{c}").cast(replica.schema[c].dataType)).otherwise(replica[c]).alias(c) if c in changed else replica[c]
        for c in replica.columns
    ]
    return joined.select(*columns)


def replace_rows(replica: DataFrame, image: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Update as replace: drop the changed rows and put their full image in."""
    keys = changed.select(key).distinct()
    kept = drop_matching(replica, keys, [key])
    return kept.unionByName(image.join(keys, key, "left_semi").select(*replica.columns))


def delete_rows(replica: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    return drop_matching(replica, deletes, [key])


def mark_existing(keys: DataFrame, replica: DataFrame, key: str, out: str = "record_exists") -> DataFrame:
    """Flags each key row with whether the replica holds its record."""
    held = replica.select(F.col(key).alias("_held")).distinct()
    return keys.join(held, keys[key] == F.col("_held"), "left").withColumn(out, F.col("_held").isNotNull()).drop("_held")


def before_after(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per field whose value differs between the replica and the change."""
    old = before.select(F.col(key).alias("_key"), *[F.col(f).cast("string").alias(f"_old_{f}") for f in fields])
    both = after.join(old, after[key] == F.col("_key"), "left")
    entries = F.array(
        *[F.struct(F.lit(f).alias("field_name"), F.col(f"_old_{f}").alias("before"), after[f].cast("string").alias("after")) for f in fields]
    )
    rows = both.select(after[key], F.explode(F.filter(entries, lambda e: ~e["before"].eqNullSafe(e["after"]))).alias("e"))
    return rows.select(key, "e.*")


def change_notices(table: str, applied: DataFrame, kind: str = "Inserted") -> DataFrame:
    """What the apply step tells its listeners: table, kind and the row."""
    return applied.select(F.lit(table).alias("table_name"), F.lit(kind).alias("event"), "*")
