"""Queries over JSON and XML documents, outbound rows, orders and interchange headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import event_to_object
from ..functions.once import computed_once
from ..operators import edi, export, orders, outbox, registry
from ..session import work_dir
from ..sources import json_docs, snapshot, xml_docs
from . import domain
from .catalog import query

STATUS = "CASE o_orderstatus WHEN 'O' THEN 'Draft' WHEN 'P' THEN 'Submitted to Manufacturing' ELSE 'Completed' END"
LINES = """ln AS (SELECT l.*, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq
   FROM lineitem l LEFT JOIN part ON p_partkey = l_partkey)"""
PRICE = "CAST(CAST(l_extendedprice AS DECIMAL(19,4)) AS VARCHAR)"
DOC = f"""{LINES}, it AS (SELECT l_orderkey AS order_id, CAST(seq AS INTEGER) AS seq_no, '<OrderItem Id="' || l_partkey || '-' || l_suppkey || '" SeqNo="' || seq || '"><Price>' || {PRICE} || '</Price><Quantity>' || CAST(l_quantity AS INTEGER)
     || '</Quantity><Product_Id>' || l_partkey || '</Product_Id><Product_Name>' || p_name || '</Product_Name></OrderItem>' AS xml FROM ln),
   doc AS (SELECT o_orderkey AS order_id, 0 AS seq_no, '<Order Id="' || o_orderkey || '" Name="O-' || o_orderkey || '"><CreatedDate>' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '</CreatedDate><Status__c>' || {STATUS}
     || '</Status__c><EdiStatus>Pending</EdiStatus><EDI_Seed>' || o_orderkey || '</EDI_Seed><Account Id="' || c_custkey || '"><AccountNumber>EDI-' || c_custkey || '</AccountNumber><AccountName>' || c_name
     || '</AccountName><AccountType>' || c_mktsegment || '</AccountType><Contact Id="C-' || c_custkey || '"><AccountId>' || c_custkey || '</AccountId><Title>EDI</Title></Contact></Account></Order>' AS xml
     FROM orders JOIN customer ON c_custkey = o_custkey)"""

# JSON and XML in ------------------------------------------------------------------------


def _responses(spark, sf_dir):
    """Query responses of up to ten records each, as paged results arrive."""
    e = domain.table(spark, sf_dir, "events")
    record = F.struct(
        F.struct(F.lit("Event").alias("type")).alias("attributes"),
        F.col("event_id").cast("string").alias("Id"),
        F.get_json_object("props", "$.k").cast("int").alias("K"),
        (F.col("value") >= 50).alias("Large"),
        F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("Name")).alias("Owner"),
        F.when(F.col("event_id") >= 10, F.lit("late")).alias("Extra"),
    )
    page = F.floor(F.col("event_id") / 10).alias("page")
    entries = e.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("event_id", F.to_json(record).alias("r")))).alias("e"))
    joined = F.array_join(F.transform("e", lambda x: x["r"]), ",")
    return entries.select("page", F.concat(F.lit('{"done":true,"records":['), joined, F.lit("]}")).alias("body"))


@query(
    "json_records",
    """SELECT CAST(event_id AS VARCHAR) AS Id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS K, value >= 50 AS Large, '{"Name":"u' || user_id || '"}' AS Owner FROM events""",
)
def json_records(spark, sf_dir):
    responses = _responses(spark, sf_dir)
    return json_docs.json_records(responses, "body", json_docs.schema_of_first_record(responses, "body", [F.col("page")]))


@query(
    "cdc_entities",
    """SELECT p_partkey, replace(p_name, ' ', '_') || CASE WHEN p_size > 25 THEN '__ChangeEvent' ELSE 'ChangeEvent' END AS QualifiedApiName, p_brand AS DeveloperName,
    replace(p_name, ' ', '_') || CASE WHEN p_size > 25 THEN '__c' ELSE '' END AS name FROM part""",
)
def cdc_entities(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    event = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") > 25, F.lit("__ChangeEvent")).otherwise(F.lit("ChangeEvent")))
    record = F.struct(F.struct(F.lit("EntityDefinition").alias("type")).alias("attributes"), event.alias("QualifiedApiName"), F.col("p_brand").alias("DeveloperName"))
    responses = p.select("p_partkey", F.to_json(F.struct(F.array(record).alias("records"))).alias("body"))
    schema = json_docs.schema_of_first_record(responses, "body", [F.col("p_partkey")])
    rows = json_docs.json_records(responses, "body", schema, keep=["p_partkey"])
    return rows.withColumn("name", event_to_object(F.col("QualifiedApiName"))).orderBy("QualifiedApiName", "p_partkey")


@query("object_catalog", "SELECT s_name AS name FROM supplier")
def object_catalog(spark, sf_dir):
    s = domain.table(spark, sf_dir, "supplier")
    listed = F.array(F.struct(F.col("s_name").alias("name")), F.struct(F.lit("Name").alias("name")))
    return json_docs.object_names(s.select(F.to_json(F.struct(listed.alias("sobjects"))).alias("body")), "body")


PARTNER_DDL = "struct<name:string,attributes:array<struct<key:string,value:string>>>"


def _partner_views(spark, sf_dir):
    e = domain.table(spark, sf_dir, "events")
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    attributes = F.array(pair("k", F.get_json_object("props", "$.k")), pair("type", F.col("event_type")))
    body = F.to_json(F.struct(F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("name"), attributes.alias("attributes")))
    return e.select("event_id", body.alias("body"))


@query(
    "json_doc_flatten",
    "SELECT event_id, 0 AS pos, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 1, 'type', event_type FROM events",
)
def json_doc_flatten(spark, sf_dir):
    return json_docs.flatten_document(_partner_views(spark, sf_dir), "body", "attributes", "struct<key:string,value:string>", ["event_id"])


@query(
    "json_doc_xml",
    """SELECT event_id, '<Root><name>P' || user_id || '</name><attributes><key>k</key><value>' || json_extract_string(props, '$.k') || '</value></attributes><attributes><key>type</key><value>' || event_type || '</value></attributes></Root>' AS xml FROM events""",
)
def json_doc_xml(spark, sf_dir):
    views = _partner_views(spark, sf_dir)
    return views.select("event_id", json_docs.document_to_xml(F.col("body"), PARTNER_DDL).alias("xml"))


@query(
    "xml_to_rows",
    f"""WITH {LINES} SELECT l_orderkey AS order_id, CAST(seq - 1 AS INTEGER) AS pos, l_partkey || '-' || l_suppkey AS _Id, CAST(seq AS INTEGER) AS _SeqNo, CAST(l_extendedprice AS DECIMAL(19,4)) AS Price, CAST(l_quantity AS INTEGER) AS Quantity,
    CAST(l_partkey AS VARCHAR) AS Product_Id, p_name AS Product_Name FROM ln""",
)
def xml_to_rows(spark, sf_dir):
    items = domain.documents_of_orders(spark, sf_dir).filter("seq_no > 0")
    parsed = xml_docs.parse_documents(items, "xml", "OrderItem", edi.ITEM_DDL, keep=["order_id", "seq_no"])
    return parsed.filter("reason is null").select("order_id", (F.col("seq_no") - 1).alias("pos"), "doc.*")


@query(
    "xml_to_accounts",
    f"""SELECT o_orderkey AS order_id, 'O-' || o_orderkey AS name, o_orderdate AS created, {STATUS} AS status, CAST(c_custkey AS VARCHAR) AS account_id, c_name AS account_name, 'C-' || c_custkey AS contact_id, CAST(NULL AS VARCHAR) AS email, CAST(coalesce(n, 0) AS INTEGER) AS n_items
    FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def xml_to_accounts(spark, sf_dir):
    rows = domain.documents_of_orders(spark, sf_dir)
    items = rows.filter("seq_no > 0").groupBy("order_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    docs = computed_once(rows.filter("seq_no = 0"), "o", edi.parse_order(F.col("xml"))).join(items, "order_id", "left")
    return docs.select(
        "order_id", F.col("o._Name").alias("name"), F.col("o.CreatedDate").alias("created"), F.col("o.Status__c").alias("status"),
        F.col("o.Account._Id").alias("account_id"), F.col("o.Account.AccountName").alias("account_name"),
        F.col("o.Account.Contact._Id").alias("contact_id"), F.col("o.Account.Contact.Email").alias("email"),
        F.coalesce("n", F.lit(0)).alias("n_items"),
    )


@query("snapshot_load", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def snapshot_load(spark, sf_dir):
    c = domain.table(spark, sf_dir, "customer")
    return snapshot.load_snapshot(c, ["c_custkey", "c_name", "c_acctbal"], work_dir(spark, "snapshot"))


@query(
    "record_lookup",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey IN (SELECT user_id FROM events)""",
)
def record_lookup(spark, sf_dir):
    c = domain.table(spark, sf_dir, "customer").withColumn("attributes", F.lit("Customer"))
    return snapshot.lookup_records(domain.change_events(spark, sf_dir), c, "record_id", "c_custkey")


# JSON and XML out -----------------------------------------------------------------------


@query(
    "rows_to_json",
    """SELECT event_id, '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0'), '0') END
    || '","user_id":' || user_id || ',"event_type":"' || event_type || '","value":' || CASE WHEN event_type = 'error' THEN 'null' ELSE CAST(value AS VARCHAR) END || '}' AS json FROM events""",
)
def rows_to_json(spark, sf_dir):
    e = domain.table(spark, sf_dir, "events")
    e = e.withColumns({"value": F.when(F.col("event_type") != "error", F.col("value")), "never": F.lit(None).cast("string")})
    return export.rows_to_json(e, " PROPS ,", keys=["event_id"])


@query(
    "rows_to_json_array",
    """SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, '{"o_orderkey":' || o_orderkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","o_orderpriority":"' || o_orderpriority || '"}' AS json
    FROM orders""",
)
def rows_to_json_array(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders").withColumn("never", F.lit(None).cast("int"))
    return export.rows_to_json_arrays(o, ["o_custkey"], [F.col("o_orderkey")], "o_custkey, o_orderstatus, o_totalprice")


@query(
    "row_to_json",
    """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_acctbal":' || CASE WHEN c_acctbal < 0 THEN 'null' ELSE CAST(c_acctbal AS VARCHAR) END || ',"c_mktsegment":"' || c_mktsegment || '"}' AS json FROM customer""",
)
def row_to_json(spark, sf_dir):
    c = domain.table(spark, sf_dir, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return export.row_to_json(c, "C_NAME, c_nationkey", keys=["c_custkey"])


@query(
    "distinct_to_xml",
    """SELECT DISTINCT c_mktsegment, c_nationkey, '<Customer><c_mktsegment>' || c_mktsegment || '</c_mktsegment><c_nationkey>' || c_nationkey || '</c_nationkey></Customer>' AS xml FROM customer""",
)
def distinct_to_xml(spark, sf_dir):
    return export.distinct_to_xml(domain.table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], "Customer")


@query(
    "json_document",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) = 1 THEN '[' ELSE ',' END || '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}'
    || CASE WHEN row_number() OVER (ORDER BY o_orderkey DESC) = 1 THEN ']' ELSE '' END AS line FROM orders""",
)
def json_document(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    body = F.to_json(export.json_ready(o, o.columns), export.KEEP_NULLS)
    return export.document_lines(o, body, [F.col("o_orderkey")], "[", "]", ",").select("o_orderkey", "line")


@query(
    "xml_document",
    """WITH d AS (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)
    SELECT c_mktsegment, c_nationkey, CASE WHEN row_number() OVER (ORDER BY c_mktsegment, c_nationkey) = 1 THEN '<X>' ELSE '' END
    || '<Customer><c_mktsegment>' || c_mktsegment || '</c_mktsegment><c_nationkey>' || c_nationkey || '</c_nationkey></Customer>'
    || CASE WHEN row_number() OVER (ORDER BY c_mktsegment DESC, c_nationkey DESC) = 1 THEN '</X>' ELSE '' END AS line FROM d""",
)
def xml_document(spark, sf_dir):
    columns = ["c_mktsegment", "c_nationkey"]
    rows = export.distinct_to_xml(domain.table(spark, sf_dir, "customer"), columns, "Customer")
    return export.document_lines(rows, F.col("xml"), [F.col(c) for c in columns], "<X>", "</X>").select(*columns, "line")


def _edited(spark, sf_dir):
    """Customers before and after an edit: some changed, some gone, suppliers added."""
    before = domain.table(spark, sf_dir, "customer")
    gone = (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") < 0)
    lowered = F.when(F.col("c_mktsegment") == "BUILDING", F.round(F.col("c_acctbal")) + 10).otherwise(F.col("c_acctbal"))
    kept = before.filter(~gone).withColumn("c_acctbal", F.when(F.col("c_mktsegment") != "FURNITURE", lowered))
    s = domain.table(spark, sf_dir, "supplier")
    added = s.select(
        (F.col("s_suppkey") + 100_000_000_000).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.lit(None).cast("int").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.lit("NEW").alias("c_mktsegment"),
    )
    return before, kept.unionByName(added)


@query(
    "outbound_changes",
    """SELECT 'update' AS op, CAST(c_custkey AS VARCHAR) AS id, '{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_acctbal":' || CASE c_mktsegment WHEN 'FURNITURE' THEN 'null' ELSE CAST(round(c_acctbal) + 10 AS VARCHAR) END || ',"c_mktsegment":"' || c_mktsegment || '"}' AS payload
    FROM customer WHERE c_mktsegment = 'FURNITURE' OR (c_mktsegment = 'BUILDING' AND round(c_acctbal) + 10 <> c_acctbal)
    UNION ALL SELECT 'insert', NULL, '{"c_name":"' || s_name || '","c_acctbal":' || s_acctbal || ',"c_mktsegment":"NEW"}' FROM supplier""",
)
def outbound_changes(spark, sf_dir):
    return export.outbound_changes(*_edited(spark, sf_dir), "c_custkey")


@query(
    "outbound_deletes",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, 'Customer' AS table_name, 'standard' AS route FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 0",
)
def outbound_deletes(spark, sf_dir):
    return export.outbound_deletes(*_edited(spark, sf_dir), "c_custkey", "Customer")


@query("order_dispatch", f"""SELECT o_orderkey AS order_id, '{{"status__c":"' || {STATUS} || '","Order_Id__c":"' || o_orderkey || '"}}' AS payload FROM orders""")
def order_dispatch(spark, sf_dir):
    o = domain.order_rows(spark, sf_dir)
    return o.select("order_id", export.status_event(F.col("order_id"), F.col("status")).alias("payload"))


@query(
    "outbox_retry",
    """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE CASE o_orderkey % 5 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 3 ELSE 1 END END AS attempts,
    CASE WHEN o_orderkey % 7 = 0 THEN 'sent' WHEN o_orderkey % 5 = 4 THEN 'failed' ELSE 'acknowledged' END AS state,
    CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 = 4 THEN 'refused 3' END AS error FROM orders""",
)
def outbox_retry(spark, sf_dir):
    """Status events of all orders in three runs; an order with remainder r by five is refused until its attempt r, one in seven gets no answer."""
    o = domain.order_rows(spark, sf_dir)
    payload = export.status_event(F.col("order_id"), F.col("status"))
    messages = o.select("order_id", payload.alias("payload")).withColumn("message_key", outbox.message_key(F.col("order_id"), F.col("payload")))
    folder = work_dir(spark, "outbox")
    ledger, landed = f"{folder}/sent", f"{folder}/results"
    results = spark.createDataFrame([], outbox.RESULTS)
    for run in (1, 2, 3):
        sent = outbox.send_due(messages, ledger, results, run).filter("order_id % 7 <> 0")
        ok = F.col("order_id") % 5 <= F.when(F.col("attempt") < 3, F.col("attempt")).otherwise(F.lit(3))
        error = F.when(~ok, F.concat(F.lit("refused "), F.col("attempt").cast("string")))
        sent.select("message_key", "attempt", ok.alias("ok"), error.alias("error")).write.mode("append").parquet(landed)
        results = spark.read.schema(outbox.RESULTS).parquet(landed)
    return outbox.outbox_report(messages, ledger, results, ["order_id"])


# Orders and documents -----------------------------------------------------------------------


def _order_changes(spark, sf_dir):
    """``events`` as status changes of orders, one order per user."""
    e = domain.table(spark, sf_dir, "events")
    status = domain.choose(F.col("event_type"), domain.EVENT_STATUS)
    return e.select(F.col("user_id").alias("order_id"), "ts", "event_id", status.alias("status"))


@query("orders_submitted", "SELECT 'Order__c' AS table_name, o_orderkey AS order_id, 'O-' || o_orderkey AS name, 'Submitted to Manufacturing' AS status FROM orders WHERE o_orderstatus = 'P'")
def orders_submitted(spark, sf_dir):
    o = domain.order_rows(spark, sf_dir).select(F.lit(orders.ORDER_TABLE).alias("table_name"), "order_id", "name", "status")
    return orders.submitted_orders(o)


@query(
    "orders_newly_submitted",
    """SELECT 'Order__c' AS table_name, user_id AS order_id, ts, event_id, 'Submitted to Manufacturing' AS status FROM
    (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type = 'view' AND b IS DISTINCT FROM 'view'""",
)
def orders_newly_submitted(spark, sf_dir):
    changes = _order_changes(spark, sf_dir).withColumn("table_name", F.lit(orders.ORDER_TABLE))
    return orders.newly_submitted_orders(changes, "order_id", ["ts", "event_id"])


MOVES = """CASE event_type WHEN 'signup' THEN 'Draft' WHEN 'view' THEN 'Submitted to Manufacturing' WHEN 'click' THEN 'Revision Required' WHEN 'purchase' THEN 'In Production' ELSE 'Completed' END"""


@query(
    "order_transitions",
    f"""WITH h AS (SELECT user_id, ts, event_id, {MOVES} AS s FROM events), l AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM h)
    SELECT user_id AS order_id, ts, event_id, s AS to_status, b AS from_status, coalesce(b = s, s = 'Draft') OR coalesce((b || '>' || s) IN ('Draft>Submitted to Manufacturing', 'Submitted to Manufacturing>Revision Required',
      'Revision Required>Submitted to Manufacturing', 'Submitted to Manufacturing>In Production', 'In Production>Completed'), FALSE) AS allowed FROM l""",
)
def order_transitions(spark, sf_dir):
    return orders.order_transitions(_order_changes(spark, sf_dir), "order_id", ["ts", "event_id"])


@query(
    "edi_status_update",
    """SELECT user_id AS order_id, CASE arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IN ('click', 'purchase')) WHEN 'click' THEN 'In Production' WHEN 'purchase' THEN 'Completed' END AS status,
    max(ts) FILTER (WHERE event_type = 'view') AS shipped_at FROM events GROUP BY user_id""",
)
def edi_status_update(spark, sf_dir):
    e = domain.table(spark, sf_dir, "events")
    documents = e.select(F.col("user_id").alias("order_id"), "ts", "event_id", domain.choose(F.col("event_type"), domain.EVENT_DOCUMENT).alias("doc_type"))
    return orders.status_after_documents(documents, "order_id", ["ts", "event_id"])


@query("order_document", f"WITH {DOC} SELECT * FROM doc UNION ALL SELECT * FROM it")
def order_document(spark, sf_dir):
    return domain.documents_of_orders(spark, sf_dir)


def _outgoing(spark, sf_dir):
    """Order headers wrapped for sending, some of them damaged by status and priority."""
    o = domain.order_rows(spark, sf_dir)
    seed = F.when(F.col("priority") == "1-URGENT", F.lit("none")).otherwise(F.col("order_id").cast("string"))
    bare = export.element_xml(F.struct(F.col("order_id").cast("string").alias("_Id"), F.col("status").alias("Status__c"), seed.alias("EDI_Seed")), "Order")
    xml = (
        F.when(F.col("priority") == "2-HIGH", bare)
        .when(F.col("priority") == "3-MEDIUM", orders.wrap_in_orders(F.concat(bare, bare)))
        .when((F.col("priority") == "5-LOW") & (F.col("status") == orders.DRAFT), F.lit("<Orders><Order>"))
        .when((F.col("priority") == "5-LOW") & (F.col("status") == orders.COMPLETED), F.lit("<ORDERS><Note/></ORDERS>"))
        .otherwise(orders.wrap_in_orders(bare))
    )
    return o.select("order_id", "account_id", "created", xml.alias("xml"))


@query(
    "edi_validate",
    """SELECT o_orderkey AS order_id, CASE o_orderpriority WHEN '2-HIGH' THEN 'more_than_one_document' WHEN '3-MEDIUM' THEN 'more_than_one_document' WHEN '1-URGENT' THEN 'control_number_is_no_integer'
      WHEN '5-LOW' THEN CASE o_orderstatus WHEN 'O' THEN 'not_well_formed' WHEN 'F' THEN 'no_order' END END AS problem,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' OR (o_orderpriority = '5-LOW' AND o_orderstatus = 'P') THEN CAST(o_orderkey AS INTEGER) END AS control_number FROM orders""",
)
def edi_validate(spark, sf_dir):
    checked = edi.validate_documents(_outgoing(spark, sf_dir), "xml")
    sendable = F.when(F.col("problem").isNull(), F.col("control_number"))
    return checked.select("order_id", "problem", sendable.alias("control_number"))


@query(
    "edi_header",
    """SELECT o_orderkey AS order_id, '850' AS doc_type, CAST(o_orderkey AS INTEGER) AS control_number, o_orderdate AS interchange_date, 'T' AS usage_indicator, 'HUB' AS sender_id, c_name AS receiver_id, 'PO' AS set_name
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '4-NOT SPECIFIED' OR (o_orderpriority = '5-LOW' AND o_orderstatus = 'P')""",
)
def edi_header(spark, sf_dir):
    valid = edi.validate_documents(_outgoing(spark, sf_dir), "xml").filter(F.col("problem").isNull())
    accounts = domain.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), "c_name")
    documents = valid.join(accounts, "account_id", "left").withColumn("doc_type", F.lit("850"))
    headers = edi.interchange_headers(documents, F.lit("HUB"), F.col("c_name"), F.col("created"))
    return headers.drop("account_id", "c_name", "created", "xml", "problem")


@query(
    "edi_set_name",
    "SELECT event_id, CASE event_type WHEN 'click' THEN '855' WHEN 'view' THEN '856' WHEN 'purchase' THEN '810' WHEN 'signup' THEN '850' ELSE '999' END AS doc_type, CASE event_type WHEN 'view' THEN 'ASN' WHEN 'purchase' THEN 'INV' WHEN 'signup' THEN 'PO' END AS set_name FROM events",
)
def edi_set_name(spark, sf_dir):
    e = domain.table(spark, sf_dir, "events")
    doc_type = domain.choose(F.col("event_type"), domain.EVENT_DOCUMENT)
    return e.select("event_id", doc_type.alias("doc_type"), edi.set_name(doc_type).alias("set_name"))


@query(
    "edi_items",
    f"""WITH {LINES} SELECT l_orderkey AS order_id, CAST(seq AS INTEGER) AS pos, l_partkey || '-' || l_suppkey AS item_id, CAST(seq AS INTEGER) AS seq_no, CAST(l_extendedprice AS DECIMAL(19,4)) AS price, CAST(l_quantity AS INTEGER) AS quantity,
    CAST(l_partkey AS VARCHAR) AS product_id, p_name AS product_name FROM ln""",
)
def edi_items(spark, sf_dir):
    return edi.document_items(domain.documents_of_orders(spark, sf_dir), "xml", ["order_id"])


@query(
    "edi_control_numbers",
    """WITH n AS (SELECT o_orderkey AS order_id, 'HUB-' || o_custkey % 3 AS sender_id, o_orderpriority AS receiver_id, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS run FROM orders),
    s AS (SELECT *, row_number() OVER (PARTITION BY sender_id, receiver_id ORDER BY run, o_orderdate, order_id) AS sequence FROM n)
    SELECT order_id, sender_id, receiver_id, sequence, lpad(CAST(sequence AS VARCHAR), 9, '0') AS control_number FROM s""",
)
def edi_control_numbers(spark, sf_dir):
    """Two runs over growing documents, the second one twice: it goes on from the first, and allots the same again."""
    o = domain.table(spark, sf_dir, "orders")
    sender = F.concat(F.lit("HUB-"), (F.col("o_custkey") % 3).cast("string"))
    documents = o.select(F.col("o_orderkey").alias("order_id"), sender.alias("sender_id"), F.col("o_orderpriority").alias("receiver_id"), "o_orderdate", "o_orderstatus")
    ledger = work_dir(spark, "control-numbers")
    allot = lambda rows, run: edi.allot_control_numbers(rows, ["sender_id", "receiver_id"], ["order_id"], [F.col("o_orderdate")], ledger, run)
    allot(documents.filter("o_orderstatus = 'F'"), 0)
    allot(documents, 1)
    return allot(documents, 1).drop("o_orderdate", "o_orderstatus")


@query(
    "document_dead_letters",
    """SELECT 'xml' AS source, event_id, 'document_unreadable' AS reason FROM events WHERE event_id % 4 = 1
    UNION ALL SELECT 'json', event_id, 'document_unreadable' FROM events WHERE event_id % 5 IN (1, 2)
    UNION ALL SELECT 'list', event_id, CASE event_id % 6 WHEN 1 THEN 'list_unreadable' WHEN 2 THEN 'list_without_object' ELSE 'list_without_fields' END FROM events WHERE event_id % 6 IN (1, 2, 3)""",
)
def document_dead_letters(spark, sf_dir):
    """Documents of three kinds, some damaged: each that gives no row is refused with a reason."""
    e = domain.table(spark, sf_dir, "events")
    name = F.concat(F.lit("O"), F.col("event_id").cast("string"))
    item = F.concat(F.lit("<Item><Id>"), name, F.when(F.col("event_id") % 4 == 1, F.lit("</Id>")).otherwise(F.lit("</Id></Item>")))
    parsed = xml_docs.parse_documents(e.select("event_id", item.alias("xml")), "xml", "Item", "struct<Id:string>", keep=["event_id"])
    body = F.when(F.col("event_id") % 5 == 1, F.lit('{"attributes":[')).when(F.col("event_id") % 5 == 2, F.lit("7")).otherwise(F.to_json(F.struct(name.alias("name"))))
    listed = (
        F.when(F.col("event_id") % 6 == 1, F.lit("<Object"))
        .when(F.col("event_id") % 6 == 2, F.lit("<Object><Field>A</Field></Object>"))
        .when(F.col("event_id") % 6 == 3, F.concat(F.lit('<Object name="'), name, F.lit('"/>')))
        .otherwise(F.concat(F.lit('<Object name="'), name, F.lit('"><Field>A</Field></Object>')))
    )
    bad_xml = xml_docs.unreadable_documents(parsed, ["event_id"]).withColumn("source", F.lit("xml"))
    bad_json = json_docs.unreadable_documents(e.select("event_id", body.alias("body")), "body", ["event_id"]).withColumn("source", F.lit("json"))
    bad_list = registry.refused_field_lists(e.select("event_id", listed.alias("xml")), "xml", ["event_id"]).withColumn("source", F.lit("list"))
    return bad_xml.unionByName(bad_json).unionByName(bad_list)
