"""JSON responses and documents as tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.once import computed_once
from .xml_docs import DOCUMENT_UNREADABLE

METADATA = "attributes"


def _kind_of(value: object) -> T.DataType:
    # Fixed rule: text is a string, true and false a boolean, a number a double, the rest a string.
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, (int, float)):
        return T.DoubleType()
    return T.StringType()


def schema_of_first_record(responses: DataFrame, text: str, order: Sequence[Column]) -> T.StructType:
    """Columns and types of the first record of the first response that has one.

    One record comes to the driver, whatever the size of the table.  The first
    response nearly always has one; only if not are all searched.
    """
    record_text = F.get_json_object(text, "$.records[0]")
    row = responses.orderBy(*order).limit(1).select(record_text.alias("r")).first()
    if row is None or row["r"] is None:
        row = responses.filter(record_text.isNotNull()).orderBy(*order).limit(1).select(record_text.alias("r")).first()
    record = json.loads(row["r"]) if row else {}
    return T.StructType([T.StructField(n, _kind_of(v)) for n, v in record.items() if n != METADATA])


def json_records(responses: DataFrame, text: str, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """One row per record; keys outside the schema drop, nested JSON stays text."""
    page = T.StructType([T.StructField("records", T.ArrayType(schema))])
    return responses.select(*keep, F.explode(F.from_json(text, page)["records"]).alias("r")).select(*keep, "r.*")


def object_names(catalogs: DataFrame, text: str) -> DataFrame:
    """Names in ``sobjects[]``, without the one called ``Name``."""
    listed = F.from_json(text, "struct<sobjects:array<struct<name:string>>>")["sobjects"]
    return catalogs.select(F.explode(listed).alias("o")).select(F.col("o.name").alias("name")).filter(F.col("name") != "Name")


def flatten_document(df: DataFrame, text: str, element: str, item: str, keys: Sequence[str]) -> DataFrame:
    """Rows of one repeated element of a JSON document, with their position.

    ``item`` is the DDL of one element.  A single object where a list is
    expected counts as a list of one.
    """
    many = F.from_json("_text", f"struct<`{element}`:array<{item}>>")[element]
    # A second parse only of the documents without a list there.
    one = F.when(F.col("_many").isNull(), F.from_json("_text", f"struct<`{element}`:{item}>")[element])
    rows = computed_once(computed_once(df.select(*keys, F.col(text).alias("_text")), "_many", many), "_one", one)
    items = F.coalesce("_many", F.when(F.col("_one").isNotNull(), F.array("_one")))
    return rows.select(*keys, F.posexplode(items).alias("pos", "item")).select(*keys, "pos", "item.*")


def unreadable_documents(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """The texts that are no JSON object, with the reason: they have no rows in ``flatten_document``."""
    read = F.schema_of_variant(F.try_parse_json(text))
    return df.filter(~F.coalesce(read.startswith("OBJECT"), F.lit(False))).select(*keys, F.lit(DOCUMENT_UNREADABLE).alias("reason"))


def document_to_xml(text: Column, schema: str, root: str = "Root") -> Column:
    """A JSON document as XML text under a root element."""
    return F.rtrim(F.to_xml(F.from_json(text, schema), {"rowTag": root, "indent": ""}), F.lit("\n"))


def record_image(df: DataFrame, attributes: Sequence[str] = (METADATA,)) -> DataFrame:
    """Every value as text, metadata columns dropped: the image of a record by id."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns if c not in attributes])
