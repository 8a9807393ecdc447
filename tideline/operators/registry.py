"""Registered objects, fields and queries; partners and partnerships."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import topic_path
from ..functions.once import computed_once
from .keys import distinct_keys, drop_matching, keep_matching

PARTNER_TYPE = "EDI Partner"
LIST_UNREADABLE = "list_unreadable"
LIST_WITHOUT_OBJECT = "list_without_object"
LIST_WITHOUT_FIELDS = "list_without_fields"
FIELD_LIST_DDL = "struct<_name:string,Field:array<string>>"


def objects_of_schema(objects: DataFrame, schemas: DataFrame, schema_id: str, kind: Column) -> DataFrame:
    return objects.filter(kind).join(schemas, schema_id, "inner")


def exclude_registered(df: DataFrame, registered: DataFrame, key: str, registered_key: str | None = None) -> DataFrame:
    """Rows not registered yet; an empty registry leaves all rows."""
    return drop_matching(df, registered, [key], [registered_key or key])


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose key is on one side only, whole and with their repeats; NULL equals NULL."""
    only_left = drop_matching(left, right, [key], null_safe=True)
    only_right = drop_matching(right, left, [key], null_safe=True)
    known = [c for c in only_right.columns if c in only_left.columns]
    return only_left.unionByName(only_right.select(*known), allowMissingColumns=True)


def replication_flags(registered: DataFrame, replicas: DataFrame, name: str, replica_name: str) -> DataFrame:
    """``initialize`` is true where no replica of that name exists, in any case."""
    have = replicas.select(F.lower(replica_name).alias("_have")).distinct()
    joined = registered.join(have, F.lower(registered[name]) == F.col("_have"), "left")
    return joined.withColumn("initialize", F.col("_have").isNull()).drop("_have")


def to_initialise(flags: DataFrame, name: str) -> DataFrame:
    return flags.filter(F.col("initialize")).select(name).distinct()


def with_roles(
    partnerships: DataFrame, accounts: DataFrame, sender: str, receiver: str, account_id: str, attributes: Sequence[str],
    shared: DataFrame | None = None, key: str | None = None,
) -> DataFrame:
    """Joins the account dimension twice, as sender and as receiver.

    ``shared`` holds the receiver of many partnerships by ``key``: it takes its
    role before it meets them, so the partnerships move once less.
    """

    def with_role(rows: DataFrame, role: str, column: str) -> DataFrame:
        side = accounts.select(F.col(account_id).alias(f"_{role}"), *[F.col(a).alias(f"{role}_{a}") for a in attributes])
        return rows.join(side, rows[column] == F.col(f"_{role}"), "left").drop(f"_{role}")

    sent = with_role(partnerships, "sender", sender)
    if shared is None:
        return with_role(sent, "receiver", receiver)
    received = with_role(shared.withColumnRenamed(key, "_key"), "receiver", receiver)
    return sent.join(received, sent[key] == F.col("_key"), "left").drop("_key")


def reconcile_partners(partners: DataFrame, accounts: DataFrame, partner_type: str = PARTNER_TYPE) -> DataFrame:
    """One row per id on either side with its status.

    ``partners(as2_id, name)`` and ``accounts(id, name, type)``.  Each side is
    reduced to one row per id first, so repeats are counted, not multiplied.
    """
    p = partners.groupBy(F.col("as2_id").alias("id")).agg(F.count(F.lit(1)).alias("n_partners"), F.min("name").alias("partner_name"))
    a = accounts.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_accounts"),
        F.min("name").alias("account_name"),
        F.min(F.col("type") == partner_type).alias("_typed"),
    )
    eligible = F.coalesce(F.col("_typed"), F.lit(False))
    status = (
        F.when(F.col("n_accounts").isNull(), F.lit("missing_account"))
        .when(F.col("n_partners").isNull() & eligible, F.lit("missing_partner"))
        .when(F.col("n_partners").isNull(), F.lit("not_a_partner"))
        .when(~eligible, F.lit("wrong_type"))
        .when((F.col("n_partners") > 1) | (F.col("n_accounts") > 1), F.lit("not_one_to_one"))
        .otherwise(F.lit("matched"))
    )
    joined = p.join(a, "id", "full_outer").withColumn("status", status)
    return joined.filter(F.col("status") != "not_a_partner").select("id", "partner_name", "account_name", "status")


def parse_field_lists(df: DataFrame, xml: str) -> DataFrame:
    """(object_name, field_name) of ``<Object name=".."><Field>..</Field></Object>`` texts."""
    parsed = df.withColumn("_p", F.from_xml(xml, FIELD_LIST_DDL, {"rowTag": "Object"}))
    return parsed.select(F.col("_p._name").alias("object_name"), F.explode("_p.Field").alias("field_name")).distinct()


def refused_field_lists(df: DataFrame, xml: str, keys: Sequence[str]) -> DataFrame:
    """Lists that register nothing, with the reason: no XML, no object name, or no field."""
    shape = f"{FIELD_LIST_DDL[:-1]},_unread:string>"
    parsed = computed_once(df, "_p", F.from_xml(xml, shape, {"rowTag": "Object", "columnNameOfCorruptRecord": "_unread"}))
    reason = (
        F.when(F.col("_p").isNull() | F.col("_p._unread").isNotNull(), F.lit(LIST_UNREADABLE))
        .when(F.col("_p._name").isNull(), F.lit(LIST_WITHOUT_OBJECT))
        .when(F.coalesce(F.size("_p.Field"), F.lit(0)) <= 0, F.lit(LIST_WITHOUT_FIELDS))
    )
    return parsed.select(*keys, reason.alias("reason")).filter(F.col("reason").isNotNull())


def register_fields(lists: DataFrame, registered: DataFrame, xml: str) -> DataFrame:
    """Listed fields that are not registered yet: the rows to append."""
    return drop_matching(parse_field_lists(lists, xml), registered, ["object_name", "field_name"])


def inserted_counts(rows: DataFrame, table: str, key: str = "object_name") -> DataFrame:
    """(rows inserted, table) per object, as the registration reports it."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows_inserted")).withColumn("table_name", F.lit(table))


def unregister(registry: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return drop_matching(registry, removed, [key])


def keyed_upsert(table: DataFrame, changes: DataFrame, key: str, deletes: DataFrame | None = None) -> DataFrame:
    """Update where the key exists, insert otherwise, then delete by key.

    The table and the changes hold one row per key.  One aggregate picks the
    row that counts, so the table is shuffled once.
    """
    row = F.struct(*table.columns)
    ranked = table.select(key, F.lit(0).alias("_rank"), row.alias("_row")).unionByName(changes.select(key, F.lit(1).alias("_rank"), row.alias("_row")))
    if deletes is not None:
        none = F.lit(None).cast(ranked.schema["_row"].dataType)
        ranked = ranked.unionByName(deletes.select(key, F.lit(2).alias("_rank"), none.alias("_row")))
    last = ranked.groupBy(key).agg(F.max(F.struct("_rank", "_row")).alias("_last"))
    return last.filter(F.col("_last._rank") < 2).select("_last._row.*")


def apply_edits(table: DataFrame, edits: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Edited values by key; a NULL edit leaves the old value. One edit row per key."""
    new = edits.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(new, table[key] == F.col("_key"), "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), table[c]).alias(c) if c in columns else table[c] for c in table.columns])


def topic_listing(objects: DataFrame, name: str, subscribed: DataFrame | None = None, fallback: str | None = None) -> DataFrame:
    """Topics of all objects, or only of the subscribed ones."""
    shown = objects if subscribed is None else keep_matching(objects, subscribed, [name])
    return distinct_keys(shown.select(topic_path(F.col(name), F.col(fallback) if fallback else None).alias("topic")), ["topic"])
