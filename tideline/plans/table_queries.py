"""Queries over whole tables: names, shapes, schemas, checks, registries, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import casts, names
from ..functions.text import error_message, html_encode, pairs_text
from ..operators import cascade, keys, ordering, registry, schema, shape
from . import domain
from .catalog import query

# Names ---------------------------------------------------------------------------

OBJECT = """obj AS (SELECT p_partkey, CASE WHEN p_size = 50 THEN ' ' ELSE replace(p_name, ' ', '_') || CASE p_size % 4 WHEN 1 THEN '__c' WHEN 2 THEN '__C' ELSE '' END END AS name,
   p_size = 50 AS blank, p_size % 4 IN (1, 2) AS custom, replace(p_name, ' ', '_') AS base FROM part)"""
EVENT = """evn AS (SELECT p_partkey, replace(p_name, ' ', '_') AS base, p_size % 5 AS m,
   CASE WHEN p_size % 5 = 4 THEN '/data/' ELSE '' END || replace(p_name, ' ', '_') || CASE p_size % 5 WHEN 1 THEN '__ChangeEvent' WHEN 2 THEN '__changeevent' WHEN 3 THEN 'changeEvents' ELSE 'ChangeEvent' END AS event_name FROM part)"""


@query(
    "name_to_event",
    f"WITH {OBJECT} SELECT p_partkey, name, CASE WHEN blank THEN NULL WHEN custom THEN base || '__ChangeEvent' ELSE base || 'ChangeEvent' END AS event_name FROM obj",
)
def name_to_event(spark, sf_dir):
    return domain.object_names(spark, sf_dir).withColumn("event_name", names.object_to_event(F.col("name")))


@query(
    "event_to_name",
    f"WITH {EVENT} SELECT p_partkey, event_name, CASE m WHEN 1 THEN base || '__c' WHEN 2 THEN event_name WHEN 3 THEN event_name ELSE base END AS name FROM evn",
)
def event_to_name(spark, sf_dir):
    return domain.event_names(spark, sf_dir).withColumn("name", names.event_to_object(F.col("event_name")))


@query(
    "event_to_name_strict",
    f"WITH {EVENT} SELECT p_partkey, event_name, CASE WHEN m IN (1, 2) THEN base || '__c' WHEN m = 3 THEN NULL ELSE base END AS name FROM evn",
)
def event_to_name_strict(spark, sf_dir):
    return domain.event_names(spark, sf_dir).withColumn("name", names.event_to_object_strict(F.col("event_name")))


@query(
    "channel_member_name",
    f"""WITH {OBJECT} SELECT p_partkey, name, CASE WHEN blank THEN NULL WHEN name LIKE '%\\_\\_c' ESCAPE '\\' THEN 'ChangeEvents_' || base || '_ChangeEvent'
    WHEN custom THEN 'ChangeEvents_' || name || '_ChangeEvent' ELSE 'ChangeEvents_' || name || 'ChangeEvent' END AS member FROM obj""",
)
def channel_member_name(spark, sf_dir):
    return domain.object_names(spark, sf_dir).withColumn("member", names.channel_member(F.col("name")))


@query(
    "topic_paths",
    """SELECT topic, row_number() OVER (ORDER BY topic, s_suppkey) AS position FROM (
      SELECT s_suppkey, '/data/' || CASE WHEN s_acctbal < 0 THEN 'Object' || s_suppkey || '__ChangeEvent' ELSE s_name || 'ChangeEvent' END AS topic FROM supplier)""",
)
def topic_paths(spark, sf_dir):
    s = domain.table(spark, sf_dir, "supplier")
    name = F.when(F.col("s_acctbal") < -500, F.lit("")).when(F.col("s_acctbal") >= 0, F.col("s_name"))
    object_name = F.concat(F.lit("Object"), F.col("s_suppkey").cast("string"), F.lit("__c"))
    topics = s.select("s_suppkey", names.topic_path(name, object_name).alias("topic"))
    return ordering.global_row_number(topics, [F.col("topic"), F.col("s_suppkey")], "position").select("topic", "position")


@query(
    "query_lineage",
    r"""SELECT doc_id, nullif(regexp_extract(text, '(?i)from[\s\x0b\x85\p{Z}]+([a-zA-Z0-9_]+)(?:[^\p{L}\p{Mn}\p{Nd}\p{Pc}]|$)', 1), '') AS object_name FROM documents""",
)
def query_lineage(spark, sf_dir):
    return domain.table(spark, sf_dir, "documents").select("doc_id", names.object_of_query(F.col("text")).alias("object_name"))


@query("derive_column", "SELECT event_id, event_type AS name FROM events")
def derive_column(spark, sf_dir):
    e = domain.table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit("ChangeEvent")).alias("SelectedEntity"))
    return shape.derive_column(e, "SelectedEntity", "name", names.event_to_object)


# Shapes --------------------------------------------------------------------------


@query("drop_null_columns", "SELECT * FROM customer")
def drop_null_columns(spark, sf_dir):
    c = domain.table(spark, sf_dir, "customer")
    return shape.drop_null_columns(c.withColumns({"Fax": F.lit(None).cast("string"), "Site": F.lit(None).cast("int")}))


@query("exclude_columns", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def exclude_columns(spark, sf_dir):
    return shape.exclude_columns(domain.table(spark, sf_dir, "customer"), " C_ACCTBAL , c_mktSegment ,missing")


@query(
    "identity_column",
    "SELECT *, 100 + 5 * (row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1) AS RowId FROM customer",
)
def identity_column(spark, sf_dir):
    c = domain.table(spark, sf_dir, "customer")
    return shape.add_identity(c, [F.col("c_acctbal").desc(), F.col("c_custkey")], "RowId", seed=100, step=5)


@query(
    "row_to_pairs",
    """SELECT c_custkey, 'c_name' AS ColumnName, c_name AS Value FROM customer UNION ALL SELECT c_custkey, 'c_custkey', CAST(c_custkey AS VARCHAR) FROM customer
    UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'c_acctbal', CASE WHEN c_acctbal >= 0 THEN CAST(c_acctbal AS VARCHAR) END FROM customer
    UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer""",
)
def row_to_pairs(spark, sf_dir):
    c = domain.table(spark, sf_dir, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return shape.row_to_pairs(c, ["c_custkey"], c.columns)


@query("distinct_projection", "SELECT DISTINCT o_orderstatus, o_orderpriority, o_custkey FROM orders")
def distinct_projection(spark, sf_dir):
    return shape.distinct_projection(domain.table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query(
    "included_fields",
    """SELECT p_brand AS object_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS position, p_name AS field_name, count(*) OVER (PARTITION BY p_brand) AS n_fields
    FROM (SELECT p_brand, p_name, min(p_size) AS s FROM part GROUP BY ALL) WHERE s <> 1 AND s <> 2""",
)
def included_fields(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    fields = p.groupBy(F.col("p_brand").alias("object_name"), "p_name").agg(F.min("p_size").alias("s"))
    excluded = F.when(F.col("s") == 1, F.lit(True)).when(F.col("s") < 20, F.lit(False))
    name = F.when(F.col("s") == 2, F.lit("")).otherwise(F.col("p_name"))
    return shape.included_fields(fields.select("object_name", name.alias("field_name"), excluded.alias("is_excluded")), ["object_name"], "field_name", "is_excluded")


@query("keep_listed", "SELECT * FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_retailprice < 905)")
def keep_listed(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    return keys.keep_matching(p, p.filter(F.col("p_retailprice") < 905).select("p_brand"), ["p_brand"])


@query("platform_events", "SELECT p_partkey, replace(p_name, ' ', '_') || '__e' AS name, TRUE AS triggerable FROM part WHERE p_size > 20 AND p_retailprice < 950")
def platform_events(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    suffix = F.when(F.col("p_size") > 20, F.lit("__e")).otherwise(F.lit("__E"))
    triggerable = F.when(F.col("p_retailprice") < 950, F.lit(True)).when(F.col("p_retailprice") < 980, F.lit(False))
    return shape.platform_events(p.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), suffix).alias("name"), triggerable.alias("triggerable")))


@query("order_list", "SELECT o_orderkey AS Id, 'O-' || o_orderkey AS name, CASE o_orderstatus WHEN 'O' THEN 'Draft' WHEN 'P' THEN 'Submitted to Manufacturing' ELSE 'Completed' END AS status FROM orders")
def order_list(spark, sf_dir):
    return domain.order_rows(spark, sf_dir).select(F.col("order_id").alias("Id"), "name", "status")


# Types and checks -------------------------------------------------------------------

DESCRIBED = """f AS (SELECT p_partkey, p_brand, p_retailprice, 'F' || p_partkey AS name, p_name AS label, p_size * 400 - 400 AS length, p_size % 2 = 0 AS nillable,
   ['string','reference','picklist','id','boolean','int','double','currency','date','datetime','textarea','Percent','email','location','multipicklist','widget'][p_size % 16 + 1] AS type FROM part)"""


@query(
    "map_types",
    f"""WITH {DESCRIBED} SELECT name, type, length, CASE WHEN type IN ('string','reference','picklist','multipicklist','id') THEN
      CASE WHEN length BETWEEN 1 AND 8000 THEN CASE WHEN type = 'id' THEN 'N' ELSE '' END || 'VARCHAR(' || length || ')' ELSE 'NVARCHAR(MAX)' END
    ELSE CASE lower(type) WHEN 'boolean' THEN 'BIT' WHEN 'int' THEN 'INT' WHEN 'double' THEN 'FLOAT' WHEN 'currency' THEN 'MONEY' WHEN 'date' THEN 'DATE' WHEN 'datetime' THEN 'DATETIME'
      WHEN 'textarea' THEN 'TEXT' WHEN 'percent' THEN 'DECIMAL(5,2)' WHEN 'email' THEN 'NVARCHAR(80)' WHEN 'location' THEN 'DECIMAL(9,6)' END END AS storage_type FROM f""",
)
def map_types(spark, sf_dir):
    f = domain.described_fields(spark, sf_dir)
    return f.select("name", "type", "length", schema.storage_type(F.col("type"), F.col("length")).alias("storage_type"))


@query(
    "typed_cast",
    """WITH s AS (SELECT event_id, event_type, value, json_extract_string(props, '$.k') AS k FROM events)
    SELECT event_id,
      CASE WHEN event_type = 'view' THEN NULL ELSE CAST(k AS INTEGER) END AS n,
      CASE WHEN event_type = 'click' THEN -CAST(k AS BIGINT) ELSE CAST(k AS BIGINT) END AS big,
      CAST(value AS DECIMAL(19,4)) AS amount,
      CASE WHEN event_type = 'error' THEN NULL ELSE value END AS ratio,
      CASE event_type WHEN 'signup' THEN TRUE WHEN 'purchase' THEN FALSE END AS flag,
      '00000000-0000-0000-0000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS guid,
      CASE WHEN k = '7' THEN NULL ELSE k END AS txt,
      nullif(concat_ws('; ', CASE WHEN event_type = 'view' THEN 'n: cannot_convert_to_int' END, CASE WHEN event_type = 'click' AND k <> '0' THEN 'big: negative_bigint' END,
        CASE WHEN event_type = 'error' THEN 'ratio: cannot_convert_to_float' END,
        CASE WHEN event_type IN ('view','click') THEN 'flag: cannot_convert_to_bit' END, CASE WHEN k = '7' THEN 'txt: not_null' END), '') AS errors
    FROM s""",
)
def typed_cast(spark, sf_dir):
    return casts.cast_columns(_text_values(spark, sf_dir), CAST_RULES, keep=["event_id"])


CAST_RULES = [
    casts.ColumnMeta("n", "int"),
    casts.ColumnMeta("big", "bigint"),
    casts.ColumnMeta("amount", "decimal"),
    casts.ColumnMeta("ratio", "float"),
    casts.ColumnMeta("flag", "bit"),
    casts.ColumnMeta("guid", "uniqueidentifier"),
    casts.ColumnMeta("txt", "nvarchar", max_length=2, nullable=False),
]


def _text_values(spark, sf_dir):
    """Text values out of ``events``, some of them no value of their column's type."""
    e = domain.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    return e.select(
        "event_id",
        F.when(kind == "view", F.concat(k, F.lit(".7"))).otherwise(F.concat(F.lit(" "), k)).alias("n"),
        F.when(kind == "click", F.concat(F.lit("-"), k)).otherwise(k).alias("big"),
        F.col("value").cast("string").alias("amount"),
        F.when(kind == "error", F.concat(F.col("value").cast("string"), F.lit("x"))).otherwise(F.col("value").cast("string")).alias("ratio"),
        domain.choose(kind, {"signup": " True ", "purchase": "FALSE", "view": "1", "click": "yes"}, "").alias("flag"),
        F.concat(F.lit("{00000000-0000-0000-0000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit("}")).alias("guid"),
        F.when(k == "7", F.lit("")).otherwise(k).alias("txt"),
    )


@query(
    "cast_quarantine",
    """SELECT event_id, concat_ws('; ', CASE WHEN event_type = 'view' THEN 'n: cannot_convert_to_int' END, CASE WHEN event_type = 'click' AND json_extract_string(props, '$.k') <> '0' THEN 'big: negative_bigint' END,
        CASE WHEN event_type = 'error' THEN 'ratio: cannot_convert_to_float' END,
        CASE WHEN event_type IN ('view','click') THEN 'flag: cannot_convert_to_bit' END, CASE WHEN json_extract_string(props, '$.k') = '7' THEN 'txt: not_null' END) AS errors
    FROM events WHERE event_type IN ('view', 'click', 'error') OR json_extract_string(props, '$.k') = '7'""",
)
def cast_quarantine(spark, sf_dir):
    _, refused = casts.split_quarantine(typed_cast(spark, sf_dir))
    return refused.select("event_id", "errors")


@query(
    "check_not_null",
    """SELECT doc_id, CASE WHEN source = 'src1' OR lang = 'de' THEN 'not_null' END AS problem FROM documents""",
)
def check_not_null(spark, sf_dir):
    d = domain.table(spark, sf_dir, "documents")
    value = F.when(F.col("source") == "src1", F.lit("")).when(F.col("lang") != "de", F.col("text"))
    return d.select("doc_id", casts.not_null_error(value, nullable=False).alias("problem"))


@query("check_length", "SELECT doc_id, CASE WHEN length(text) > 500 THEN 'too_long' END AS problem FROM documents")
def check_length(spark, sf_dir):
    return domain.table(spark, sf_dir, "documents").select("doc_id", casts.length_error(F.col("text"), 500).alias("problem"))


@query("check_non_negative", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative_bigint' END AS problem FROM customer")
def check_non_negative(spark, sf_dir):
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    return domain.table(spark, sf_dir, "customer").select("c_custkey", casts.negative_error(cents).alias("problem"))


@query(
    "cast_datetime",
    """SELECT event_id, CASE event_type WHEN 'click' THEN date_trunc('second', ts) WHEN 'view' THEN ts WHEN 'signup' THEN date_trunc('day', ts) WHEN 'purchase' THEN ts - INTERVAL 2 HOUR END AS at FROM events""",
)
def cast_datetime(spark, sf_dir):
    e = domain.table(spark, sf_dir, "events")
    kind, ts = F.col("event_type"), F.col("ts")
    whole = F.date_trunc("second", ts.cast("timestamp"))
    text = (
        F.when(kind == "click", F.unix_millis(whole).cast("string"))
        .when(kind == "view", ts.cast("string"))
        .when(kind == "signup", F.date_format(ts, "M/d/yyyy"))
        .when(kind == "purchase", F.concat(F.replace(ts.cast("string"), F.lit(" "), F.lit("T")), F.lit("+02:00")))
        .otherwise(F.lit("no date"))
    )
    return e.select("event_id", casts.cast_datetime(text).alias("at"))


@query("match_columns", "SELECT c_custkey AS C_CustKey, c_name AS C_NAME, c_acctbal FROM customer")
def match_columns(spark, sf_dir):
    return schema.match_columns(domain.table(spark, sf_dir, "customer"), ["C_CustKey", "C_NAME", "c_acctbal", "c_unknown"])


@query(
    "describe_fields",
    f"""WITH {DESCRIBED} SELECT 'Object' || p_partkey AS object, name, type, label, length, nillable AS nullable,
    CASE type WHEN 'string' THEN '''' || label || '''' WHEN 'boolean' THEN CASE WHEN nillable THEN '1' ELSE '0' END WHEN 'int' THEN CAST(length AS VARCHAR) END AS default,
    CASE WHEN type = 'reference' THEN 'Owner' END AS relationship_name, CASE WHEN type = 'reference' THEN 'User,Group' ELSE '' END AS reference_to FROM f""",
)
def describe_fields(spark, sf_dir):
    return schema.describe_fields(domain.describe_documents(spark, sf_dir), "body")


@query(
    "default_literal",
    """SELECT event_id, CASE event_type WHEN 'click' THEN json_extract_string(props, '$.k') WHEN 'view' THEN '''' || json_extract_string(props, '$.k') || '''' WHEN 'signup' THEN '1' WHEN 'purchase' THEN '0' END AS literal FROM events""",
)
def default_literal(spark, sf_dir):
    e = domain.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    quoted = F.concat(F.lit('"'), k, F.lit('"'))
    value = F.when(F.col("event_type") == "view", quoted).otherwise(domain.choose(F.col("event_type"), {"signup": "true", "purchase": "false"}, "null"))
    body = F.concat(F.lit('{"defaultValue":'), F.when(F.col("event_type") == "click", k).otherwise(value), F.lit("}"))
    return e.select("event_id", schema.default_literal(schema.json_token(body, "defaultValue")).alias("literal"))


@query(
    "child_relations",
    f"WITH {DESCRIBED} SELECT 'Object' || p_partkey AS object, 'Children_' || name AS name, label AS child_sobject, 'ParentId' AS field, nillable AS cascade FROM f WHERE nillable",
)
def child_relations(spark, sf_dir):
    return schema.child_relations(domain.describe_documents(spark, sf_dir), "body")


@query(
    "picklist_values",
    "SELECT 'Customer' || c_custkey AS object, c_mktsegment AS label, upper(c_mktsegment) || '-' || c_nationkey AS value, c_acctbal >= 0 AS is_active FROM customer WHERE c_nationkey <> 3",
)
def picklist_values(spark, sf_dir):
    c = domain.table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_nationkey") == 3, F.lit("string")).otherwise(F.lit("picklist"))
    value = F.struct(
        F.col("c_mktsegment").alias("label"),
        F.concat(F.upper("c_mktsegment"), F.lit("-"), F.col("c_nationkey").cast("string")).alias("value"),
        (F.col("c_acctbal") >= 0).alias("active"),
    )
    other = F.struct(F.lit("Other__c").alias("name"), F.lit("picklist").alias("type"), F.array(value).alias("picklistValues"))
    field = F.struct(F.lit("Segment__c").alias("name"), kind.alias("type"), F.array(value).alias("picklistValues"))
    body = F.to_json(F.struct(F.concat(F.lit("Customer"), F.col("c_custkey").cast("string")).alias("name"), F.array(other, field).alias("fields")))
    return schema.picklist_values(c.select(body.alias("body")), "body", "Segment__c")


@query(
    "check_primary_key",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows, 'duplicate_key' AS problem FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def check_primary_key(spark, sf_dir):
    return schema.primary_key_violations(domain.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("check_foreign_key", "SELECT l.* FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def check_foreign_key(spark, sf_dir):
    parents = domain.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "F")
    return schema.foreign_key_orphans(domain.table(spark, sf_dir, "lineitem"), parents, ["l_orderkey"], ["o_orderkey"])


@query(
    "apply_defaults",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN TIMESTAMP '2023-01-01' ELSE ts END AS ts, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS event_type,
    CASE WHEN event_type = 'click' THEN -1.5 ELSE value END AS value, event_type IN ('signup', 'purchase') AS flag, CASE WHEN event_type = 'signup' THEN 'none' ELSE props END AS props FROM events""",
)
def apply_defaults(spark, sf_dir):
    kind = F.col("event_type")
    holes = domain.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind != "error", F.col("ts")).alias("ts"),
        F.when(kind != "view", kind).alias("event_type"),
        F.when(kind != "click", F.col("value")).alias("value"),
        F.when(kind == "signup", F.lit(True)).when(kind != "purchase", F.lit(False)).alias("flag"),
        F.when(kind != "signup", F.col("props")).alias("props"),
    )
    return schema.apply_defaults(holes, {"value": -1.5, "flag": True, "props": "none"})


@query(
    "object_exists",
    "SELECT s_suppkey, CASE WHEN s_suppkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') THEN s_suppkey ELSE -1 END AS object_id FROM supplier",
)
def object_exists(spark, sf_dir):
    s = domain.table(spark, sf_dir, "supplier")
    catalog = domain.table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "BUILDING")
    asked = s.select("s_suppkey", F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"))
    return schema.object_ids(asked, catalog, "name", "c_name", "c_custkey").drop("name")


# Registries ----------------------------------------------------------------------------


@query("catalog_join", "SELECT c_custkey, c_name, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_regionkey = 1")
def catalog_join(spark, sf_dir):
    schemas = domain.table(spark, sf_dir, "nation").filter(F.col("n_regionkey") == 1).withColumnRenamed("n_nationkey", "c_nationkey")
    objects = domain.table(spark, sf_dir, "customer")
    joined = registry.objects_of_schema(objects, schemas, "c_nationkey", F.col("c_mktsegment") == "BUILDING")
    return joined.select("c_custkey", "c_name", "n_name", "n_regionkey")


@query("exclude_registered", "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def exclude_registered(spark, sf_dir):
    registered = domain.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P")
    return registry.exclude_registered(domain.table(spark, sf_dir, "customer"), registered, "c_custkey", "o_custkey")


@query(
    "symmetric_difference",
    """WITH f AS (SELECT CASE WHEN o_custkey < 20 THEN NULL ELSE o_custkey END AS o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'),
    o AS (SELECT CASE WHEN o_custkey < 5 THEN NULL ELSE o_custkey END AS o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O')
    SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey IS NOT DISTINCT FROM f.o_custkey)
    UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE o.o_custkey IS NOT DISTINCT FROM f.o_custkey)""",
)
def symmetric_difference(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders")

    def side(status, unknown_below):
        key = F.when(F.col("o_custkey") >= unknown_below, F.col("o_custkey"))
        return o.filter(F.col("o_orderstatus") == status).select(key.alias("o_custkey"), "o_orderkey", "o_totalprice")

    return registry.symmetric_difference(side("F", 20), side("O", 5), "o_custkey")


def _flags(spark, sf_dir):
    registered = domain.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    replicas = domain.table(spark, sf_dir, "orders").select(F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"))
    return registry.replication_flags(registered, replicas, "c_name", "name")


@query("replication_flags", "SELECT c_custkey, c_name, c_custkey NOT IN (SELECT o_custkey FROM orders) AS initialize FROM customer")
def replication_flags(spark, sf_dir):
    return _flags(spark, sf_dir)


@query("to_initialise", "SELECT DISTINCT c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def to_initialise(spark, sf_dir):
    return registry.to_initialise(_flags(spark, sf_dir), "c_name")


@query(
    "partnership_roles",
    """SELECT l_orderkey, l_linenumber, l_partkey, s_name AS sender_name, s_nationkey AS sender_nation, c_name AS receiver_name, c_nationkey AS receiver_nation
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN customer ON c_custkey = o_custkey""",
)
def partnership_roles(spark, sf_dir):
    l, o = domain.table(spark, sf_dir, "lineitem"), domain.table(spark, sf_dir, "orders")
    s, c = domain.table(spark, sf_dir, "supplier"), domain.table(spark, sf_dir, "customer")
    accounts = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).unionByName(
        c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    )
    lines = l.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sender_id"))
    deals = o.select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("receiver_id"))
    return registry.with_roles(lines, accounts, "sender_id", "receiver_id", "id", ["name", "nation"], deals, "l_orderkey").drop("sender_id", "receiver_id")


@query(
    "partner_reconcile",
    """WITH p AS (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT s_suppkey + 100000000, s_name FROM supplier WHERE s_nationkey = 1)
    SELECT id, any_value(p.name) AS partner_name, any_value(c_name) AS account_name,
      CASE WHEN any_value(c_custkey) IS NULL THEN 'missing_account' WHEN any_value(p.name) IS NULL THEN 'missing_partner' WHEN any_value(c_mktsegment) <> 'BUILDING' THEN 'wrong_type' WHEN count(*) > 1 THEN 'not_one_to_one' ELSE 'matched' END AS status
    FROM (SELECT coalesce(id, c_custkey) AS id, p.name, c_custkey, c_name, c_mktsegment FROM p FULL JOIN customer ON id = c_custkey) p WHERE p.name IS NOT NULL OR c_mktsegment = 'BUILDING' GROUP BY id""",
)
def partner_reconcile(spark, sf_dir):
    s, c = domain.table(spark, sf_dir, "supplier"), domain.table(spark, sf_dir, "customer")

    def partner(rows, key):
        return rows.select(key.alias("as2_id"), F.col("s_name").alias("name"))

    known = partner(s.filter(F.col("s_acctbal") > 0), F.col("s_suppkey"))
    twice = partner(s.filter(F.col("s_acctbal") > 9000), F.col("s_suppkey"))
    unknown = partner(s.filter(F.col("s_nationkey") == 1), F.col("s_suppkey") + 100_000_000)
    kind = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(registry.PARTNER_TYPE)).otherwise(F.col("c_mktsegment"))
    accounts = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), kind.alias("type"))
    return registry.reconcile_partners(known.unionByName(twice).unionByName(unknown), accounts)


def _field_lists(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    xml = F.concat(F.lit('<Object name="'), "p_brand", F.lit('"><Field>'), "p_name", F.lit("</Field><Field>Size_"), F.col("p_size").cast("string"), F.lit("</Field></Object>"))
    registered = p.filter(F.col("p_retailprice") < 950).select(F.col("p_brand").alias("object_name"), F.col("p_name").alias("field_name"))
    return registry.register_fields(p.select(xml.alias("xml")), registered, "xml")


NEW_FIELDS = """nf AS (SELECT p_brand AS object_name, p_name AS field_name FROM part UNION SELECT p_brand, 'Size_' || p_size FROM part
    EXCEPT SELECT p_brand, p_name FROM part WHERE p_retailprice < 950)"""


@query("register_fields", f"WITH {NEW_FIELDS} SELECT * FROM nf")
def register_fields(spark, sf_dir):
    return _field_lists(spark, sf_dir)


@query("registered_counts", f"WITH {NEW_FIELDS} SELECT object_name, count(*) AS rows_inserted, 'CDCObjectFields' AS table_name FROM nf GROUP BY 1")
def registered_counts(spark, sf_dir):
    return registry.inserted_counts(_field_lists(spark, sf_dir), "CDCObjectFields")


@query("unregister_object", "SELECT * FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def unregister_object(spark, sf_dir):
    removed = domain.table(spark, sf_dir, "nation").filter(F.col("n_regionkey") == 2).select(F.col("n_nationkey").alias("s_nationkey"))
    return registry.unregister(domain.table(spark, sf_dir, "supplier"), removed, "s_nationkey")


@query(
    "keyed_upsert",
    """SELECT item_id AS q_key, CASE WHEN length(text) > 200 THEN 'select ' || item_id ELSE text END AS q, length(text) > 200 AS use_tooling FROM benchmark WHERE length(text) >= 100
    UNION ALL SELECT item_id + 1000000, 'select ' || item_id, TRUE FROM benchmark WHERE length(text) > 200""",
)
def keyed_upsert(spark, sf_dir):
    b = domain.table(spark, sf_dir, "benchmark")
    stored = b.select(F.col("item_id").alias("q_key"), F.col("text").alias("q"), F.lit(False).alias("use_tooling"))
    long = b.filter(F.length("text") > 200)
    text = F.concat(F.lit("select "), F.col("item_id").cast("string")).alias("q")
    known = long.select(F.col("item_id").alias("q_key"), text, F.lit(True).alias("use_tooling"))
    added = long.select((F.col("item_id") + 1_000_000).alias("q_key"), text, F.lit(True).alias("use_tooling"))
    removed = b.filter(F.length("text") < 100).select(F.col("item_id").alias("q_key"))
    return registry.keyed_upsert(stored, known.unionByName(added), "q_key", removed)


@query("apply_edits", "SELECT p_partkey, p_name, CASE WHEN p_type = 'PROMO' THEN 'edited' ELSE p_brand END AS p_brand, p_type, p_size, CASE WHEN p_type = 'PROMO' AND p_size > 25 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part")
def apply_edits(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    price = F.when(F.col("p_size") > 25, F.col("p_retailprice") + 1)
    edits = p.filter(F.col("p_type") == "PROMO").select("p_partkey", F.lit("edited").alias("p_brand"), price.alias("p_retailprice"))
    return registry.apply_edits(p, edits, "p_partkey", ["p_brand", "p_retailprice"])


@query("topics_subscribed", "SELECT DISTINCT '/data/' || c_name || 'ChangeEvent' AS topic FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def topics_subscribed(spark, sf_dir):
    c, o = domain.table(spark, sf_dir, "customer"), domain.table(spark, sf_dir, "orders")
    names_of = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("c_name")
    return registry.topic_listing(c, "c_name", o.filter(F.col("o_orderstatus") == "P").select(names_of))


@query("topics_all", "SELECT DISTINCT '/data/' || c_name || 'ChangeEvent' AS topic FROM customer")
def topics_all(spark, sf_dir):
    return registry.topic_listing(domain.table(spark, sf_dir, "customer"), "c_name")


# Counts, orders and sets ---------------------------------------------------------------------


@query("count_by_key", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def count_by_key(spark, sf_dir):
    return shape.count_by_key(domain.table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("result_counts", "SELECT count(*) AS n_rows FROM orders WHERE o_orderstatus = 'F'")
def result_counts(spark, sf_dir):
    return shape.row_count(domain.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F"))


@query(
    "null_profile",
    """WITH d AS (SELECT doc_id, quality, CASE WHEN toxic = 1 THEN toxic END AS toxic, CAST(NULL AS VARCHAR) AS note FROM documents LEFT JOIN labels USING (doc_id))
    SELECT 'doc_id' AS column_name, count(*) AS n_rows, count(*) - count(doc_id) AS n_null, count(*) > count(doc_id) AS any_null, count(doc_id) = 0 AS all_null FROM d
    UNION ALL SELECT 'quality', count(*), count(*) - count(quality), count(*) > count(quality), count(quality) = 0 FROM d
    UNION ALL SELECT 'toxic', count(*), count(*) - count(toxic), count(*) > count(toxic), count(toxic) = 0 FROM d
    UNION ALL SELECT 'note', count(*), count(*), TRUE, TRUE FROM d""",
)
def null_profile(spark, sf_dir):
    d = domain.table(spark, sf_dir, "documents").select("doc_id").join(domain.table(spark, sf_dir, "labels"), "doc_id", "left")
    d = d.withColumns({"toxic": F.when(F.col("toxic") == 1, F.col("toxic")), "note": F.lit(None).cast("string")})
    return shape.null_profile(d, ["doc_id", "quality", "toxic", "note"])


@query(
    "joined_list",
    """SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY pair) AS position, pair, count(*) OVER (PARTITION BY o_orderstatus) AS n_pairs
    FROM (SELECT DISTINCT o_orderstatus, o_orderpriority || '=' || o_orderstatus AS pair FROM orders)""",
)
def joined_list(spark, sf_dir):
    return shape.joined_list(domain.table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority", "o_orderstatus")


@query("row_pairs_text", "SELECT o_orderkey, 'o_orderkey=' || o_orderkey || ', o_orderstatus=' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END || ', o_orderpriority=' || o_orderpriority AS pairs FROM orders")
def row_pairs_text(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return o.select("o_orderkey", pairs_text(["o_orderkey", "o_orderstatus", "o_orderpriority"]).alias("pairs"))


@query("distinct_keys", "SELECT DISTINCT o_custkey FROM orders")
def distinct_keys(spark, sf_dir):
    return keys.distinct_keys(domain.table(spark, sf_dir, "orders"), ["o_custkey"])


@query("scalar_or_default", "SELECT coalesce((SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'X'), 0) AS none_found, (SELECT max(o_orderkey) FROM orders) AS found")
def scalar_or_default(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders")
    missing = F.max(F.when(F.col("o_orderstatus") == "X", F.col("o_orderkey")))
    return shape.scalars_or_default(o, none_found=(missing, 0), found=(F.max("o_orderkey"), 0))


@query("sort_names", "SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS position FROM part")
def sort_names(spark, sf_dir):
    return shape.sort_by_name(domain.table(spark, sf_dir, "part").select("p_name", "p_partkey"), "p_name")


@query("first_record", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1")
def first_record(spark, sf_dir):
    return shape.first_record(domain.table(spark, sf_dir, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")])


def _accounts(spark, sf_dir):
    c = domain.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    s = domain.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return c, s


@query("union_all", "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def union_all(spark, sf_dir):
    return shape.union_all(*_accounts(spark, sf_dir))


@query("append_rows", "SELECT c_name AS Name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier")
def append_rows(spark, sf_dir):
    c = domain.table(spark, sf_dir, "customer").select(F.col("c_name").alias("Name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = domain.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("NATION"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("extra"))
    return shape.append_rows(c, s)


@query("dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def dedupe(spark, sf_dir):
    return shape.dedupe(domain.table(spark, sf_dir, "events").select("user_id", "event_type"))


# Texts ------------------------------------------------------------------------------------


@query(
    "error_messages",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'plain ' || props WHEN 'click' THEN 'Error: bad ' || user_id || ' (Code: N/A, Fields: )'
    WHEN 'error' THEN 'Error: bad ' || user_id || ' (Code: E1, Fields: A, B); Error: Unknown error (Code: E2, Fields: )' ELSE '' END AS message FROM events""",
)
def error_messages(spark, sf_dir):
    e = domain.table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    body = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("plain "), "props"))
        .when(F.col("event_type") == "click", F.concat(F.lit('[{"message":"bad '), user, F.lit('"}]')))
        .when(F.col("event_type") == "error", F.concat(F.lit('[{"message":"bad '), user, F.lit('","errorCode":"E1","fields":["A","B"]},{"errorCode":"E2","fields":[]}]')))
        .otherwise(F.lit("[]"))
    )
    return e.select("event_id", error_message(body).alias("message"))


@query(
    "html_encode",
    """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS encoded FROM pages""",
)
def html_encoded(spark, sf_dir):
    return domain.table(spark, sf_dir, "pages").select("page_id", html_encode(F.col("html")).alias("encoded"))


@query(
    "cascade_delete",
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
    SELECT 'Customer' AS entity, CAST(c_custkey AS VARCHAR) AS record_id FROM c UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR) FROM o
    UNION ALL SELECT DISTINCT 'Line', l_orderkey || '-' || l_partkey || '-' || l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""",
)
def cascade_delete(spark, sf_dir):
    """Customers in the red go, their orders with them, and the orders' lines; parts only lose a pointer."""
    tables, ids = _cascade_tables(spark, sf_dir)
    deletes = tables["Customer"].filter("c_acctbal < 0").select(F.lit("Customer").alias("entity"), F.col("c_custkey").alias("record_id"))
    return cascade.cascaded(deletes, cascade.relation_links(tables, ids, CASCADE))


CASCADE = (
    cascade.Relation("Customer", "Order", "o_custkey"),
    cascade.Relation("Order", "Line", "l_orderkey"),
    cascade.Relation("Customer", "Note", "about", cascade=False),
)


def _cascade_tables(spark, sf_dir):
    line = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey")
    tables = {
        "Customer": domain.table(spark, sf_dir, "customer"),
        "Order": domain.table(spark, sf_dir, "orders"),
        "Line": domain.table(spark, sf_dir, "lineitem").withColumn("line_id", line),
        "Note": domain.table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("about")),
    }
    return tables, {"Customer": "c_custkey", "Order": "o_orderkey", "Line": "line_id", "Note": "p_partkey"}


@query(
    "cascade_cleared",
    "SELECT p_partkey, CASE WHEN p_partkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN p_partkey END AS about FROM part",
)
def cascade_cleared(spark, sf_dir):
    tables, ids = _cascade_tables(spark, sf_dir)
    deletes = tables["Customer"].filter("c_acctbal < 0").select(F.lit("Customer").alias("entity"), F.col("c_custkey").alias("record_id"))
    return cascade.delete_cascading(tables, ids, CASCADE, deletes)["Note"]
