"""Outbound rows as JSON and XML text, and change sets between two images."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import drop_matching
from .ordering import indexed_rows, row_number_within
from .shape import columns_with_values, exclude_columns

KEEP_NULLS = {"ignoreNullFields": "false"}
DROP_NULLS = {"ignoreNullFields": "true"}
TOOLING_TABLES = ("PlatformEventChannelMember",)  # fixed value: rows deleted by the tooling route


def json_ready(df: DataFrame, columns: Sequence[str]) -> Column:
    """A struct of the columns, times as ISO text with all their digits."""
    times = {f.name for f in df.schema.fields if f.dataType.typeName().startswith("timestamp")}
    iso = [F.replace(F.col(c).cast("string"), F.lit(" "), F.lit("T")).alias(c) if c in times else F.col(c) for c in columns]
    return F.struct(*iso)


def rows_to_json(df: DataFrame, excluded: str | Iterable[str] = (), keys: Sequence[str] = (), out: str = "json") -> DataFrame:
    """One JSON object per row: no excluded columns, no column without a value.

    An array of all rows would be one value in one task; rows stay rows, and a
    JSON-lines write gives the same records.
    """
    shown = exclude_columns(df, excluded)
    columns = columns_with_values(shown)
    return df.select(*keys, F.to_json(json_ready(df, columns), KEEP_NULLS).alias(out))


def rows_to_json_arrays(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], excluded: str | Iterable[str] = (), out: str = "json"
) -> DataFrame:
    """The elements of each group's JSON array: one object per row, with its place from 1.

    An array of any size stays rows; written in order they are the array.
    """
    columns = columns_with_values(exclude_columns(df, excluded))
    placed = row_number_within(df, keys, order, "_place")
    return placed.select(*keys, F.col("_place").alias("position"), F.to_json(json_ready(df, columns), KEEP_NULLS).alias(out))


def row_to_json(df: DataFrame, excluded: str | Iterable[str] = (), keys: Sequence[str] = (), out: str = "json") -> DataFrame:
    """Every row as JSON; excluded names must match in case here."""
    columns = exclude_columns(df, excluded, case_sensitive=True).columns
    return df.select(*keys, F.to_json(json_ready(df, columns), KEEP_NULLS).alias(out))


def distinct_to_xml(df: DataFrame, columns: Sequence[str], table: str, out: str = "xml") -> DataFrame:
    """Distinct rows of a column subset as ``<table>`` elements of the root ``X``."""
    rows = df.select(*columns).distinct()
    return rows.select(*columns, element_xml(F.struct(*columns), table).alias(out))


def write_xml(df: DataFrame, path: str, table: str, root: str = "X") -> None:
    """The same document as files, one root per file."""
    df.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", table).save(path)


def document_lines(
    df: DataFrame, text: Column, order: Sequence[Column], opening: str, closing: str, separator: str = "", partitions: int | None = None, out: str = "line"
) -> DataFrame:
    """Lines of one document of any size, in order: the lines of all partitions, one after the other, are the document.

    Rows are range-partitioned, so no task sees more than its share; the first row
    of all carries the opening text, each other one the separator, the last one the
    closing text.  Rows that tie in ``order`` stand in any order.  Without rows there
    is no line to carry them; ``write_document`` writes both.  The count of rows runs
    while the frame is built.
    """
    indexed, total = indexed_rows(df, order, partitions)
    head = F.when(F.col("_index") == 0, F.lit(opening)).otherwise(F.lit(separator))
    tail = F.when(F.col("_index") == total - 1, F.lit(closing)).otherwise(F.lit(""))
    return indexed.withColumn(out, F.concat(head, text, tail)).drop("_part", "_pos", "_index")


def write_document(
    df: DataFrame, text: Column, order: Sequence[Column], path: str, opening: str, closing: str, separator: str = "", partitions: int | None = None
) -> None:
    """One valid document from many tasks: the part files, concatenated by name, are it."""
    lines = document_lines(df, text, order, opening, closing, separator, partitions, "value").select("value")
    if df.isEmpty():
        lines = df.sparkSession.createDataFrame([(opening + closing,)], "value string").coalesce(1)
    lines.write.mode("overwrite").text(path)


def write_json_array(df: DataFrame, order: Sequence[Column], path: str, excluded: str | Iterable[str] = (), partitions: int | None = None) -> None:
    """All rows as one JSON array in part files; no excluded columns, no column without a value."""
    columns = columns_with_values(exclude_columns(df, excluded))
    write_document(df, F.to_json(json_ready(df, columns), KEEP_NULLS), order, path, "[", "]", ",", partitions)


def write_xml_document(df: DataFrame, order: Sequence[Column], path: str, table: str, root: str = "X", partitions: int | None = None) -> None:
    """All rows as elements of one root in part files."""
    write_document(df, element_xml(F.struct(*df.columns), table), order, path, f"<{root}>", f"</{root}>", "", partitions)


def element_xml(value: Column, tag: str) -> Column:
    """One element on one line."""
    return F.rtrim(F.to_xml(value, {"rowTag": tag, "indent": ""}), F.lit("\n"))


def outbound_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(op, id, payload) for modified and added rows.

    Modified rows send all columns but the key.  Each added row is sent on its
    own, so the columns it has no value for are left out.
    """
    fields = [c for c in after.columns if c != key]
    old = before.select(F.col(key).alias("_key"), json_ready(before, fields).alias("_old"))
    joined = after.join(old, after[key] == F.col("_key"), "left")
    new = json_ready(after, fields)
    added = F.col("_key").isNull()
    op = F.when(added, F.lit("insert")).when(~F.col("_old").eqNullSafe(new), F.lit("update"))
    payload = F.when(added, F.to_json(new, DROP_NULLS)).otherwise(F.to_json(new, KEEP_NULLS))
    return joined.select(op.alias("op"), F.when(~added, after[key].cast("string")).alias("id"), payload.alias("payload")).filter(
        F.col("op").isNotNull()
    )


def outbound_deletes(before: DataFrame, after: DataFrame, key: str, table: str) -> DataFrame:
    """Ids that are gone, with the route their table takes."""
    gone = drop_matching(before, after, [key])
    path = F.when(F.lit(table).isin(*TOOLING_TABLES), F.lit("tooling")).otherwise(F.lit("standard"))
    return gone.select(F.col(key).cast("string").alias("id"), F.lit(table).alias("table_name"), path.alias("route"))


def status_event(order_id: Column, status: Column) -> Column:
    """Payload that announces a decided order status."""
    return F.to_json(F.struct(status.alias("status__c"), order_id.cast("string").alias("Order_Id__c")), KEEP_NULLS)
