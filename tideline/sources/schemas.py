"""Payloads read by the schema their event names.

Each event carries the id of the schema it was written with.  The registry holds
the schemas as Avro JSON; the reader wants certain fields.  For every registered
schema the two are resolved once, as a row: which written field each wanted field
comes from (by name, or by an alias where it was renamed), which take their
default because the writer has no such field, or why that schema cannot be read.
Fields the reader does not want are left.  Events are joined to those few rows,
so a schema registered later is one more row and no new code.

Changed fields may come as names or as bitmaps over the writer's field order
(``0x0a``; ``3-0x02`` for the parts of field 3); both end as the reader's names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.once import computed_once
from ..functions.text import UNKNOWN
from ..operators.delta import dead_letter_reason, header_fields

HEADER_DDL = "struct<entityName:string,changeType:string,recordIds:array<string>,changedFields:array<string>>"
FIELD_DDL = "struct<name:string,type:string>"

SCHEMA_UNKNOWN = "schema_unknown"
SCHEMA_UNREADABLE = "schema_unreadable"
FIELD_MISSING = "field_missing"
NOT_PROMOTABLE = "type_not_promotable"

# Which written types the Avro rules let a reader take as its own.
PROMOTIONS = {
    "int": ("int",),
    "bigint": ("int", "long"),
    "float": ("int", "long", "float"),
    "double": ("int", "long", "float", "double"),
    "string": ("string", "bytes", "enum"),
    "boolean": ("boolean",),
}
_REQUIRED = object()


@dataclass(frozen=True)
class WantedField:
    """A field the reader wants; without ``default`` every writer must have it."""

    name: str
    kind: str
    default: object = _REQUIRED
    aliases: Sequence[str] = ()


def _branch(kind: Column, wanted: str) -> Column:
    """The branch of a type text that is a record (or is none): unions and objects looked through."""
    branches = F.when(kind.startswith("["), F.from_json(kind, "array<string>")).otherwise(F.array(kind))
    is_record = lambda b: b.startswith("{") & (F.get_json_object(b, "$.type") == "record")
    keep = (lambda b: is_record(b)) if wanted == "record" else (lambda b: (b != "null") & ~F.coalesce(is_record(b), F.lit(False)))
    return F.try_element_at(F.filter(branches, keep), F.lit(1))


def plain_type(kind: Column) -> Column:
    """Name of the type behind a type text: ``["null",{"type":"long",...}]`` is ``long``."""
    one = _branch(kind, "plain")
    return F.when(one.startswith("{"), F.get_json_object(one, "$.type")).otherwise(one)


def part_names(kind: Column) -> Column:
    """Names of the parts of a compound field; empty for a plain one."""
    record = F.from_json(_branch(kind, "record"), f"struct<fields:array<{FIELD_DDL}>>")
    return F.coalesce(F.transform(record["fields"], lambda f: f["name"]), F.array().cast("array<string>"))


def resolve(registry: DataFrame, wanted: Sequence[WantedField], schema_id: str = "schema_id", schema_json: str = "schema_json") -> DataFrame:
    """One row per registered schema: (schema_id, names, parts, sources, problem).

    ``names`` are its fields in order and ``parts`` those of compound ones;
    ``sources`` maps each wanted field to the written one, without those that take
    their default; ``problem`` says why the schema cannot be read.  A schema
    registered again counts once.
    """
    parsed = computed_once(registry.select(F.col(schema_id).alias("schema_id"), F.col(schema_json).alias("_text")).distinct(), "_fields", F.from_json("_text", f"struct<fields:array<{FIELD_DDL}>>")["fields"])
    entries, problem = [], F.when(F.col("_fields").isNull(), F.lit(SCHEMA_UNREADABLE))
    for field in wanted:
        names = [field.name, *field.aliases]
        found = F.try_element_at(F.filter("_fields", lambda f: f["name"].isin(*names)), F.lit(1))  # noqa: B023
        fits = plain_type(found["type"]).isin(*PROMOTIONS[field.kind])
        if field.default is _REQUIRED:
            problem = problem.when(found.isNull(), F.lit(f"{FIELD_MISSING}:{field.name}"))
        problem = problem.when(found.isNotNull() & ~F.coalesce(fits, F.lit(False)), F.lit(f"{NOT_PROMOTABLE}:{field.name}"))
        entries.append(F.struct(F.lit(field.name).alias("k"), found["name"].alias("v")))
    sources = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))
    resolved = parsed.select(
        "schema_id",
        F.transform("_fields", lambda f: f["name"]).alias("names"),
        F.transform("_fields", lambda f: part_names(f["type"])).alias("parts"),
        sources.alias("sources"),
        problem.alias("problem"),
    )
    # Two texts under one id: the readable one, then the smaller text, counts.
    best = F.min_by(F.struct("names", "parts", "sources", "problem"), F.struct(F.col("problem").isNotNull(), F.to_json("names")))
    return resolved.groupBy("schema_id").agg(best.alias("r")).select("schema_id", "r.*")


def _bits(text: Column, names: Column) -> Column:
    """The names whose bit is set in hexadecimal text; the first name is the last bit."""
    digits = F.lower(F.reverse(text))

    def is_set(_: Column, i: Column) -> Column:
        place = F.floor(i / 4).cast("int")
        digit = F.position(F.substring(digits, place + 1, F.lit(1)), F.lit("0123456789abcdef")) - 1
        step = F.element_at(F.array(*[F.lit(2**b) for b in range(4)]), (i % 4 + 1).cast("int"))
        return (F.length(digits) > place) & (F.floor(digit / step) % 2 == 1)

    return F.filter(names, is_set)


def changed_names(changed: Column, names: Column, parts: Column) -> Column:
    """Changed fields as the writer's names, whether they come as names or as bitmaps.

    The bits of a compound field's parts name the field itself and each part as
    ``field.part``.  A bitmap that no schema explains stays as it is.
    """

    def expand(entry: Column) -> Column:
        whole = F.regexp_extract(entry, "^0x([0-9A-Fa-f]+)$", 1)
        inner = F.regexp_extract(entry, "^[0-9]+-0x([0-9A-Fa-f]+)$", 1)
        at = F.regexp_extract(entry, "^([0-9]+)-0x", 1).try_cast("int") + 1
        parent, below = F.try_element_at(names, at), F.try_element_at(parts, at)
        own = F.array(entry)
        nested = F.concat(F.array(parent), F.transform(_bits(inner, below), lambda n: F.concat(parent, F.lit("."), n)))
        return (
            F.when(names.isNull(), own)
            .when(whole != "", _bits(whole, names))
            .when((inner != "") & parent.isNotNull(), nested)
            .otherwise(own)
        )

    return F.array_distinct(F.flatten(F.transform(changed, expand)))


def decode_by_schema(events: DataFrame, registry: DataFrame, wanted: Sequence[WantedField]) -> DataFrame:
    """Header, change type and wanted fields of split events, each read by its own schema, with the refusal reason.

    The registry's resolved rows are few; Spark broadcasts them by their size.
    """
    joined = events.join(resolve(registry, wanted), "schema_id", "left")
    text = F.try_to_binary("payload", F.lit("base64")).cast("string")
    record = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    flat = computed_once(joined, "_m", record)
    value = lambda name, kind: F.try_variant_get(F.col("_m")[name], "$", kind)
    columns = []
    for field in wanted:
        source = F.col("sources")[field.name]
        given = value(source, field.kind)
        default = F.lit(None) if field.default is _REQUIRED else F.lit(field.default)
        usable = F.col("names").isNotNull() & F.col("problem").isNull()
        columns.append(F.when(usable, F.when(source.isNull(), default.cast(field.kind)).otherwise(given)).alias(field.name))
    kept = [c for c in events.columns if c not in ("payload", "reason")]
    header = value(F.lit("ChangeEventHeader"), HEADER_DDL)
    at = value(F.lit("commit_ts"), "string").try_cast("timestamp_ntz")
    flat = flat.select(*kept, F.col("reason").alias("_split"), "names", "parts", "sources", "problem", F.col("_m").isNotNull().alias("_read"), header.alias("ChangeEventHeader"), at.alias("commit_ts"), *columns)
    named = header_fields(flat).withColumn("change_type", F.coalesce(F.col("ChangeEventHeader.changeType"), F.lit(UNKNOWN)))
    # The writer's names as the reader's; those it does not want are left.
    written = F.when(F.col("problem").isNull(), changed_names(F.col("changed_fields"), F.col("names"), F.col("parts")))
    own = F.filter(F.map_entries("sources"), lambda e: F.array_contains(written, e["value"]))
    named = named.withColumn("changed_fields", F.coalesce(F.transform(own, lambda e: e["key"]), F.array().cast("array<string>")))
    data = [f.name for f in wanted]
    filled = sum((F.col(f).isNotNull().cast("int") for f in data), F.lit(0))
    refused = dead_letter_reason(F.col("ChangeEventHeader"), F.col("_read"), F.col("change_type"), filled + F.size("changed_fields"), F.col("record_ids"))
    unknown = F.when(F.col("names").isNull() & F.col("problem").isNull(), F.lit(SCHEMA_UNKNOWN))
    reason = F.coalesce("_split", unknown, "problem", refused)
    return named.withColumn("reason", reason).drop("_split", "_read", "ChangeEventHeader", "names", "parts", "sources", "problem")


def wanted_schema(wanted: Sequence[WantedField]) -> T.StructType:
    """The wanted fields as columns of a replica."""
    return T.StructType.fromDDL(", ".join(f"`{f.name}` {f.kind}" for f in wanted))
