"""The given tables in the roles of the change-capture and order domain.

Nothing is filtered or sampled here: every row of a table plays its role.
Batches, orders and documents are built from the rows, so they grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import entity_topic, object_to_event
from ..operators.keys import keep_matching
from ..operators.orders import COMPLETED, DRAFT, IN_PRODUCTION, REVISION, SUBMITTED, order_documents
from ..sources.feed import pack_envelopes, payload_schema
from ..sources.schemas import WantedField

DATA_FIELDS = {"Value__c": T.DoubleType(), "K__c": T.IntegerType()}
PAYLOAD = payload_schema(DATA_FIELDS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(value: Column, options: dict, default=None) -> Column:
    result = F.lit(default)
    for key, chosen in options.items():
        result = F.when(value == key, F.lit(chosen)).otherwise(result)
    return result


# Change events -----------------------------------------------------------------


def change_events(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``events`` as decoded change events: signup creates, error deletes, the rest update.

    ``extra`` names columns of the table to carry along.
    """
    return change_events_of(table(spark, sf_dir, "events"), extra)


def change_events_of(e: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    kind = F.col("event_type")
    value_set = kind.isin("click", "purchase", "signup")
    k_set = kind.isin("view", "purchase", "signup")
    k = F.get_json_object("props", "$.k").cast("int")
    changed = F.array_compact(F.array(F.when(value_set, F.lit("Value__c")), F.when(k_set, F.lit("K__c"))))
    return e.select(
        F.col("event_id").alias("replay_id"),
        F.col("ts").alias("commit_ts"),
        F.col("user_id").cast("string").alias("record_id"),
        choose(F.col("user_id") % 3, {0: "Account", 1: "Order__c"}, "Product__c").alias("entity"),
        choose(kind, {"signup": "CREATE", "error": "DELETE"}, "UPDATE").alias("change_type"),
        F.array(F.col("user_id").cast("string")).alias("record_ids"),
        changed.alias("changed_fields"),
        F.when(value_set, F.col("value")).alias("Value__c"),
        F.when(k_set, k).alias("K__c"),
        *extra,
    )


def with_topic(df: DataFrame) -> DataFrame:
    return df.withColumn("topic", entity_topic(object_to_event(F.col("entity"))))


def wire_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events as they come over the wire, some of them damaged.

    Damage goes by the event's value, so that every refusal reason occurs.
    """
    c = with_topic(change_events(spark, sf_dir, ("value",)))
    v = F.col("value")
    no_fields = v.between(10, 12)
    header = F.struct(
        F.col("entity").alias("entityName"),
        F.when(v.between(8, 9.99), F.lit("GAP_CREATE")).otherwise(F.col("change_type")).alias("changeType"),
        F.col("record_ids").alias("recordIds"),
        F.when(~no_fields, F.col("changed_fields")).alias("changedFields"),
    )
    record = F.struct(
        F.when(~v.between(6, 7.99), header).alias("ChangeEventHeader"),
        F.col("commit_ts").cast("string").alias("commit_ts"),
        F.when(~no_fields, F.col("Value__c")).alias("Value__c"),
        F.when(~no_fields, F.col("K__c")).alias("K__c"),
    )
    text = F.when(v.between(4, 5.99), F.lit("no json")).otherwise(F.to_json(record))
    event = F.struct(
        F.col("replay_id").cast("string").alias("id"),
        F.when(v >= 2, F.concat(F.lit("S-"), F.col("entity"))).alias("schema_id"),
        F.when(~v.between(2, 3.99), F.base64(F.encode(text, "utf-8"))).alias("payload"),
        F.array().cast("array<struct<key:string,value:binary>>").alias("headers"),
    )
    return c.select("topic", "replay_id", event.alias("event"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of up to ten events of a topic, as one fetch returns them."""
    return pack_envelopes(wire_events(spark, sf_dir), "topic", ["replay_id"], F.floor(F.col("replay_id") / 10))


def schema_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One schema per entity of the feed."""
    entities = change_events(spark, sf_dir).select("entity").distinct()
    return entities.select(
        F.concat(F.lit("S-"), "entity").alias("schema_id"),
        F.concat(F.lit('{"type":"record","name":"'), "entity", F.lit('"}')).alias("schema_json"),
    )


# Schema versions ------------------------------------------------------------------

# What a reader of all versions wants: a field that was renamed and widened, one with a default, one every writer has.
WANTED = (
    WantedField("Value__c", "double", aliases=("Amount__c",)),
    WantedField("K__c", "double"),
    WantedField("Grade__c", "string", default="none"),
)
_HEADER_FIELD = '{"name":"ChangeEventHeader","type":{"type":"record","name":"H","fields":[{"name":"entityName","type":"string"}]}},{"name":"commit_ts","type":"string"}'
# Version 2 renames Value__c, types K__c differently and drops Grade__c; 3 makes K__c a text, which a number cannot be read from.
_VERSION_FIELDS = {
    "1": '{"name":"Value__c","type":["null","double"]},{"name":"K__c","type":["null","int"]},{"name":"Grade__c","type":"string"}',
    "2": '{"name":"K__c","type":["null",{"type":"double"}]},{"name":"Amount__c","type":["null","float"]}',
    "3": '{"name":"Value__c","type":"double"},{"name":"K__c","type":"string"}',
}


def version_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schemas of all versions of every entity of the feed, and one that is no JSON."""
    entities = change_events(spark, sf_dir).select("entity").distinct()
    texts = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(f'{{"type":"record","name":"E","fields":[{_HEADER_FIELD},{f}]}}').alias("t")) for v, f in _VERSION_FIELDS.items()], F.struct(F.lit("4").alias("v"), F.lit("no schema").alias("t")))
    rows = entities.select("entity", F.explode(texts).alias("s"))
    return rows.select(F.concat_ws("-", F.lit("S"), F.col("s.v"), "entity").alias("schema_id"), F.col("s.t").alias("schema_json"))


def versioned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events written with five schema versions, by turns; the changed fields are bitmaps over the writer's order."""
    c = with_topic(change_events(spark, sf_dir))
    version = F.col("replay_id") % 5 + 1
    value, k = F.array_contains("changed_fields", "Value__c"), F.array_contains("changed_fields", "K__c")
    # Bits 2, 3 and 4 of versions 1 and 3 are Value__c, K__c and Grade__c; of version 2 bit 2 is K__c, bit 3 Amount__c.
    weight = lambda v, b: F.when(v, F.lit(b)).otherwise(F.lit(0))
    bits = F.when(version == 2, weight(value, 8) + weight(k, 4)).otherwise(weight(value, 4) + weight(k, 8))
    bitmap = F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(bits), 4, "0")))
    header = F.struct(F.col("entity").alias("entityName"), F.col("change_type").alias("changeType"), F.col("record_ids").alias("recordIds"), F.array(bitmap).alias("changedFields"))
    both = [header.alias("ChangeEventHeader"), F.col("commit_ts").cast("string").alias("commit_ts")]
    payload = (
        F.when(version == 2, F.to_json(F.struct(*both, F.col("K__c").cast("double").alias("K__c"), F.col("Value__c").alias("Amount__c"))))
        .when(version == 3, F.to_json(F.struct(*both, "Value__c", F.col("K__c").cast("string").alias("K__c"))))
        .otherwise(F.to_json(F.struct(*both, "Value__c", "K__c", F.lit("A").alias("Grade__c"))))
    )
    schema_id = F.concat_ws("-", F.lit("S"), version.cast("string"), "entity")
    return c.select("topic", "replay_id", schema_id.alias("schema_id"), F.base64(F.encode(payload, "utf-8")).alias("payload"), F.lit(None).cast("string").alias("reason"))


# Names -------------------------------------------------------------------------


def object_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as objects: plain, custom, custom in capitals, or blank names."""
    p = table(spark, sf_dir, "part")
    suffix = choose(F.col("p_size") % 4, {1: "__c", 2: "__C"}, "")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), suffix)
    return p.select("p_partkey", F.when(F.col("p_size") == 50, F.lit(" ")).otherwise(name).alias("name"))


def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as event names, some in another case, with a topic prefix, or no event at all."""
    p = table(spark, sf_dir, "part")
    base = F.replace("p_name", F.lit(" "), F.lit("_"))
    ending = choose(F.col("p_size") % 5, {0: "ChangeEvent", 1: "__ChangeEvent", 2: "__changeevent", 3: "changeEvents"}, "ChangeEvent")
    prefix = F.when(F.col("p_size") % 5 == 4, F.lit("/data/")).otherwise(F.lit(""))
    return p.select("p_partkey", F.concat(prefix, base, ending).alias("event_name"))


# Described schemas ---------------------------------------------------------------

# A field type for each part size modulo 16, as describe rows carry them.
DESCRIBED_TYPES = (
    "string", "reference", "picklist", "id", "boolean", "int", "double", "currency",
    "date", "datetime", "textarea", "Percent", "email", "location", "multipicklist", "widget",
)


def described_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as described fields: one per part, the last type unknown to the map."""
    p = table(spark, sf_dir, "part")
    types = F.array(*[F.lit(t) for t in DESCRIBED_TYPES])
    return p.select(
        F.concat(F.lit("F"), F.col("p_partkey")).alias("name"),
        F.element_at(types, (F.col("p_size") % 16 + 1).cast("int")).alias("type"),
        F.col("p_name").alias("label"),
        (F.col("p_size") * 400 - 400).alias("length"),
        (F.col("p_size") % 2 == 0).alias("nillable"),
        F.col("p_partkey"),
        F.col("p_retailprice"),
        F.col("p_brand"),
    )


def describe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One describe document per part: an object with one field and one relation."""
    f = described_fields(spark, sf_dir)
    # The kind of the default differs by type: text, number, boolean or none.
    default = (
        F.when(F.col("type") == "string", F.concat(F.lit('"'), F.col("label"), F.lit('"')))
        .when(F.col("type") == "boolean", F.when(F.col("nillable"), F.lit("true")).otherwise(F.lit("false")))
        .when(F.col("type") == "int", F.col("length").cast("string"))
        .otherwise(F.lit("null"))
    )
    field = F.concat(
        F.lit('{"name":"'), "name", F.lit('","type":"'), "type", F.lit('","label":"'), "label",
        F.lit('","length":'), F.col("length").cast("string"), F.lit(',"nillable":'), F.col("nillable").cast("string"),
        F.lit(',"defaultValue":'), default,
        F.lit(',"relationshipName":'), F.when(F.col("type") == "reference", F.lit('"Owner"')).otherwise(F.lit("null")),
        F.lit(',"referenceTo":'), F.when(F.col("type") == "reference", F.lit('["User","Group"]')).otherwise(F.lit("[]")),
        F.lit("}"),
    )
    relation = F.concat(
        F.lit('{"relationshipName":'),
        F.when(F.col("nillable"), F.concat(F.lit('"Children_'), "name", F.lit('"'))).otherwise(F.lit("null")),
        F.lit(',"childSObject":"'), "label", F.lit('","field":"ParentId","cascadeDelete":'), F.col("nillable").cast("string"), F.lit("}"),
    )
    doc = F.concat(
        F.lit('{"name":"Object'), F.col("p_partkey").cast("string"), F.lit('","fields":['), field,
        F.lit('],"childRelationships":['), relation, F.lit("]}"),
    )
    return f.select("p_partkey", doc.alias("body"))


# Orders -------------------------------------------------------------------------

ORDER_STATUS = {"O": DRAFT, "P": SUBMITTED, "F": COMPLETED}
EVENT_STATUS = {"signup": DRAFT, "view": SUBMITTED, "click": REVISION, "purchase": IN_PRODUCTION, "error": COMPLETED}
EVENT_DOCUMENT = {"click": "855", "view": "856", "purchase": "810", "signup": "850", "error": "999"}


def order_status(code: Column) -> Column:
    return choose(code, ORDER_STATUS)


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as the order object."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("name"),
        order_status(F.col("o_orderstatus")).alias("status"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").alias("created"),
        F.col("o_orderpriority").alias("priority"),
    )


def documents_of_orders(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """XML document of every order (of those in ``only``) as rows: account, then items in order, price with four decimals."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "order_id")
    if only is not None:
        lines = keep_matching(lines, only, ["order_id"])
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    described = lines.join(part, lines.l_partkey == part.p_partkey, "left")
    item = [
        F.concat(F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("_Id"),
        F.col("l_extendedprice").cast("decimal(19,4)").alias("Price"),
        F.col("l_quantity").cast("int").alias("Quantity"),
        F.col("l_partkey").cast("string").alias("Product_Id"),
        F.col("p_name").alias("Product_Name"),
    ]
    # Line numbers repeat inside an order, so the order of items uses all line columns.
    lead = ["l_linenumber", "l_partkey", "l_suppkey"]
    order = [F.col(c) for c in lead + [c for c in lines.columns if c not in ("order_id", *lead)]]
    accounts = table(spark, sf_dir, "customer").withColumn("_id", F.col("c_custkey").cast("string"))
    wanted = order_rows(spark, sf_dir) if only is None else keep_matching(order_rows(spark, sf_dir), only, ["order_id"])
    headers = wanted.join(accounts, F.col("account_id") == F.col("c_custkey"), "left")
    contact = F.struct(F.concat(F.lit("C-"), "_id").alias("_Id"), F.col("_id").alias("AccountId"), F.lit("EDI").alias("Title"))
    account = F.struct(
        F.col("_id").alias("_Id"),
        F.concat(F.lit("EDI-"), "_id").alias("AccountNumber"),
        F.col("c_name").alias("AccountName"),
        F.col("c_mktsegment").alias("AccountType"),
        contact.alias("Contact"),
    )
    header = [
        F.col("order_id").cast("string").alias("_Id"),
        F.col("name").alias("_Name"),
        F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss").alias("CreatedDate"),
        F.col("status").alias("Status__c"),
        F.lit("Pending").alias("EdiStatus"),
        F.col("order_id").alias("EDI_Seed"),
        account.alias("Account"),
    ]
    return order_documents(headers, described, "order_id", header, order, item)
