"""Text helpers: change type, type tags, HTML encoding, error messages, joined pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
# Fixed value: where the header text states the change type.
CHANGE_TYPE_IN_HEADER = r"(?U)value:\s*(\w+)"
ERROR_LIST = "array<struct<message:string,errorCode:string,fields:array<string>>>"


def change_type_of(header_text: Column) -> Column:
    found = F.nullif(F.regexp_extract(header_text, CHANGE_TYPE_IN_HEADER, 1), F.lit(""))
    return F.coalesce(found, F.lit(UNKNOWN))


def type_tag(doc: Column) -> Column:
    """Text after the last colon of a field's documentation."""
    return F.coalesce(F.element_at(F.split(doc, ":"), -1), F.lit(UNKNOWN))


def html_encode(text: Column) -> Column:
    # The five characters with their entities, ampersand first.
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def error_message(body: Column) -> Column:
    """One line for a JSON error list; text that is no such list is returned as it is."""
    parsed = F.from_json(body, ERROR_LIST)
    lines = F.transform(
        parsed,
        lambda e: F.concat(
            F.lit("Error: "),
            F.coalesce(e["message"], F.lit("Unknown error")),
            F.lit(" (Code: "),
            F.coalesce(e["errorCode"], F.lit("N/A")),
            F.lit(", Fields: "),
            F.coalesce(F.array_join(e["fields"], ", "), F.lit("")),
            F.lit(")"),
        ),
    )
    is_list = F.ltrim(body).startswith("[") & parsed.isNotNull()
    return F.when(is_list, F.array_join(lines, "; ")).otherwise(body)


def pairs_text(columns: Sequence[str]) -> Column:
    """``name=value, name=value`` over one row; a NULL shows as nothing."""
    pairs = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return F.concat_ws(", ", *pairs)
