"""Described schemas: type mapping, describe JSON, checks and defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import ColumnMeta
from .keys import drop_matching

# CRM type to storage type. {n} takes the described length.
SIZED_TYPES = {
    "string": "VARCHAR",
    "reference": "VARCHAR",
    "picklist": "VARCHAR",
    "multipicklist": "VARCHAR",
    "id": "NVARCHAR",
}
STORAGE_TYPES = {
    "boolean": "BIT",
    "int": "INT",
    "long": "BIGINT",
    "double": "FLOAT",
    "currency": "MONEY",
    "date": "DATE",
    "datetime": "DATETIME",
    "textarea": "TEXT",
    "url": "VARCHAR(MAX)",
    "encryptedstring": "VARBINARY(MAX)",
    "email": "NVARCHAR(80)",
    "address": "NVARCHAR(4000)",
    "phone": "NVARCHAR(80)",
    "anytype": "SQL_VARIANT",
    "complexvalue": "NVARCHAR(MAX)",
    "combobox": "NVARCHAR(255)",
    "json": "NVARCHAR(MAX)",
    "percent": "DECIMAL(5,2)",
    "time": "TIME",
    "base64": "VARCHAR(MAX)",
    "location": "DECIMAL(9,6)",
}
UNSIZED = "NVARCHAR(MAX)"
MAX_SIZED = 8000
DEFAULT_DATE = "2023-01-01"

# Spark types behind the storage types; text types are strings with a length.
SPARK_TYPES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "currency": T.DecimalType(19, 4),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "encryptedstring": T.BinaryType(),
    "anytype": T.VariantType(),
    "percent": T.DecimalType(5, 2),
    "location": T.DecimalType(9, 6),
}

def storage_type(crm_type: Column, length: Column, strict: bool = False) -> Column:
    """Storage type of a described field; an unknown type has none, or raises."""
    kind = F.lower(crm_type)
    sized = length.between(1, MAX_SIZED)
    known = F.create_map(*[F.lit(x) for pair in STORAGE_TYPES.items() for x in pair])
    families = F.create_map(*[F.lit(x) for pair in SIZED_TYPES.items() for x in pair])
    family = F.try_element_at(families, kind)
    result = F.coalesce(
        F.when(family.isNotNull() & sized, F.concat(family, F.lit("("), length.cast("string"), F.lit(")"))),
        F.when(family.isNotNull(), F.lit(UNSIZED)),
        F.try_element_at(known, kind),
    )
    if strict:
        return F.when(result.isNull(), F.raise_error(F.concat(F.lit("type is not supported: "), crm_type))).otherwise(result)
    return result


def spark_schema(fields: Sequence[Mapping[str, object]]) -> T.StructType:
    """StructType of one object from its describe rows (name, type, length, nullable)."""
    columns = []
    for f in fields:
        kind = str(f["type"]).lower()
        if kind not in SIZED_TYPES and kind not in STORAGE_TYPES:
            raise ValueError(f"type {f['type']!r} of {f['name']!r} is not supported")
        meta = {"length": int(f.get("length") or 0)}
        columns.append(T.StructField(str(f["name"]), SPARK_TYPES.get(kind, T.StringType()), bool(f.get("nullable", True)), meta))
    return T.StructType(columns)


def column_metas(fields: Sequence[Mapping[str, object]]) -> list[ColumnMeta]:
    """Cast rules of one object from its describe rows."""
    money = "decimal(19,4)"
    metas = []
    for f in fields:
        kind = str(f["type"]).lower()
        length = int(f.get("length") or 0)
        if kind in SIZED_TYPES:
            name, limit = "nvarchar", length if 0 < length <= MAX_SIZED else -1
        else:
            storage = STORAGE_TYPES[kind]
            size = storage.split("(")[1].rstrip(")") if "(" in storage else ""
            name = money if kind == "currency" else storage.lower() if storage.startswith("DECIMAL") else storage.split("(")[0].lower()
            limit = int(size) if size.isdigit() else -1
        metas.append(ColumnMeta(str(f["name"]), name, limit, bool(f.get("nullable", True))))
    return metas


def describe_fields(df: DataFrame, text: str) -> DataFrame:
    """One row per field of each describe document."""
    # get_json_object keeps the JSON kind of defaultValue, which from_json loses.
    raw = df.select(
        F.get_json_object(text, "$.name").alias("object"),
        F.explode(F.from_json(F.get_json_object(text, "$.fields"), "array<string>")).alias("f"),
    )
    shape = "name:string,type:string,label:string,length:int,nillable:boolean,relationshipName:string,referenceTo:array<string>"
    return raw.withColumn("p", F.from_json("f", f"struct<{shape}>")).select(
        "object",
        F.col("p.name").alias("name"),
        F.col("p.type").alias("type"),
        F.col("p.label").alias("label"),
        F.col("p.length").alias("length"),
        F.col("p.nillable").alias("nullable"),
        default_literal(json_token(F.col("f"), "defaultValue")).alias("default"),
        F.col("p.relationshipName").alias("relationship_name"),
        F.coalesce(F.array_join("p.referenceTo", ","), F.lit("")).alias("reference_to"),
    )


def json_token(doc: Column, name: str) -> Column:
    """The JSON text of one property, strings with their quotes; NULL if missing or null.

    Numbers come in Spark's own text: ``1.50`` reads ``1.5``.
    """
    value = F.try_variant_get(F.try_parse_json(doc), f"$.{name}", "variant")
    return F.to_json(F.when(~F.is_variant_null(value), value))


def default_literal(token: Column) -> Column:
    """A default as literal text: strings quoted, booleans 1 or 0, the rest raw."""
    text = F.get_json_object(F.concat(F.lit('{"v":'), token, F.lit("}")), "$.v")
    return (
        F.when(token.startswith('"'), F.concat(F.lit("'"), text, F.lit("'")))
        .when(token == "true", F.lit("1"))
        .when(token == "false", F.lit("0"))
        .when(token != "null", token)
    )


def child_relations(df: DataFrame, text: str) -> DataFrame:
    """Child relations with a name; a name that is no string counts as none."""
    rel = "array<struct<relationshipName:string,childSObject:string,field:string,cascadeDelete:boolean>>"
    parsed = F.from_json(F.get_json_object(text, "$.childRelationships"), rel)
    kept = F.filter(parsed, lambda r: r["relationshipName"].isNotNull())
    return df.select(F.get_json_object(text, "$.name").alias("object"), F.explode(kept).alias("r")).select(
        "object",
        F.col("r.relationshipName").alias("name"),
        F.col("r.childSObject").alias("child_sobject"),
        F.col("r.field").alias("field"),
        F.col("r.cascadeDelete").alias("cascade"),
    )


def picklist_values(df: DataFrame, text: str, field: str, strict: bool = False) -> DataFrame:
    """Values of one picklist field; a missing field or another type gives none, or raises."""
    fields = F.from_json(F.get_json_object(text, "$.fields"), "array<struct<name:string,type:string,picklistValues:array<struct<label:string,value:string,active:boolean>>>>")
    found = F.try_element_at(F.filter(fields, lambda f: f["name"] == field), F.lit(1))
    usable = found.isNotNull() & (found["type"] == "picklist")
    values = F.when(F.coalesce(usable, F.lit(False)), found["picklistValues"])
    if strict:
        values = values.otherwise(F.raise_error(F.lit(f"{field} is missing or no picklist")))
    return df.select(F.get_json_object(text, "$.name").alias("object"), F.explode(values).alias("v")).select(
        "object", F.col("v.label").alias("label"), F.col("v.value").alias("value"), F.col("v.active").alias("is_active")
    )


def match_columns(df: DataFrame, target: Sequence[str]) -> DataFrame:
    """The columns both sides know, any case, under the target's names and order."""
    known = {c.lower(): c for c in df.columns}
    matched = [F.col(known[t.lower()]).alias(t) for t in target if t.lower() in known]
    if not matched:
        raise ValueError("no column of the data is in the target")
    return df.select(*matched)


def primary_key_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are NULL or held by several rows, with their row count."""
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(k).isNull()
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("problem", F.when(missing, F.lit("null_key")).when(F.col("n_rows") > 1, F.lit("duplicate_key")))
        .filter(F.col("problem").isNotNull())
    )


def foreign_key_orphans(child: DataFrame, parent: DataFrame, child_key: Sequence[str], parent_key: Sequence[str]) -> DataFrame:
    """Child rows whose key is set but has no parent."""
    present = child.dropna(how="any", subset=list(child_key))
    return drop_matching(present, parent, child_key, parent_key)


def apply_defaults(df: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Fills NULLs by type: the given default, the fixed date for dates, '' for other text."""
    given = defaults or {}
    columns = []
    for field in df.schema.fields:
        c = F.col(field.name)
        kind = field.dataType
        if isinstance(kind, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            c = F.coalesce(c, F.lit(DEFAULT_DATE).cast(kind))
        elif field.name in given:
            c = F.coalesce(c, F.lit(given[field.name]).cast(kind))
        elif isinstance(kind, T.StringType):
            c = F.coalesce(c, F.lit(""))
        columns.append(c.alias(field.name))
    return df.select(*columns)


def object_ids(names: DataFrame, catalog: DataFrame, name: str, catalog_name: str, catalog_id: str, out: str = "object_id") -> DataFrame:
    """Id of each named object, -1 when the catalog has none."""
    ids = catalog.groupBy(F.col(catalog_name).alias("_name")).agg(F.min(catalog_id).alias("_id"))
    return names.join(ids, names[name] == F.col("_name"), "left").withColumn(out, F.coalesce(F.col("_id"), F.lit(-1))).drop("_name", "_id")
