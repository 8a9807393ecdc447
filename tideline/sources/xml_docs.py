"""XML documents as tables: one table per repeated element."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.once import computed_once

DOCUMENT_UNREADABLE = "document_unreadable"


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """XML files, one row per ``row_tag`` element; the schema is given, never inferred."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def parse_documents(df: DataFrame, xml: str, row_tag: str, schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """XML texts in a column, parsed once each: ``doc``, or NULL and the ``reason`` why a text cannot be read.

    ``schema`` is a struct's DDL.
    """
    shape = f"{schema.rstrip()[:-1]},_unread:string>"
    read = F.from_xml("_xml", shape, {"rowTag": row_tag, "columnNameOfCorruptRecord": "_unread"})
    parsed = computed_once(df.select(*keep, F.col(xml).alias("_xml")), "_doc", read)
    unread = F.col("_xml").isNull() | F.col("_doc").isNull() | F.col("_doc._unread").isNotNull()
    return parsed.select(*keep, F.when(~unread, F.col("_doc").dropFields("_unread")).alias("doc"), F.when(unread, F.lit(DOCUMENT_UNREADABLE)).alias("reason"))


def unreadable_documents(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The documents ``parse_documents`` could not read, with the reason: they have no rows in ``element_table``."""
    return parsed.filter(F.col("reason").isNotNull()).select(*keys, "reason")


def element_table(parsed: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """One row per repeated element below ``path``, with its keys and position."""
    return parsed.select(*keys, F.posexplode(f"doc.{path}").alias("pos", "element")).select(*keys, "pos", "element.*")
