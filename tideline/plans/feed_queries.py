"""Queries over the change feed: envelopes, decode, deltas, apply."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import entity_topic, object_to_event
from ..functions.text import type_tag
from ..operators import apply, delta
from ..session import work_dir
from ..sources import feed, schemas
from ..streaming import apply as streams
from . import domain
from .catalog import query

EV = """ev AS (
  SELECT event_id AS replay_id, ts AS commit_ts, CAST(user_id AS VARCHAR) AS record_id, user_id, event_type, value AS raw_value,
    CASE user_id % 3 WHEN 0 THEN 'Account' WHEN 1 THEN 'Order__c' ELSE 'Product__c' END AS entity,
    CASE user_id % 3 WHEN 0 THEN '/data/AccountChangeEvent' WHEN 1 THEN '/data/Order__ChangeEvent' ELSE '/data/Product__ChangeEvent' END AS topic,
    CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS change_type,
    CASE WHEN event_type IN ('click','purchase','signup') THEN value END AS Value__c,
    CASE WHEN event_type IN ('view','purchase','signup') THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS K__c
  FROM events)"""

REASON = """CASE WHEN raw_value < 2 THEN 'schema_id_missing' WHEN raw_value < 4 THEN 'payload_missing'
    WHEN raw_value < 6 THEN 'decode_failed' WHEN raw_value < 8 THEN 'no_header'
    WHEN raw_value < 10 THEN 'unknown_change_type'
    WHEN raw_value <= 12 AND change_type <> 'DELETE' THEN 'no_matching_column' END"""

CHANGED = """CASE event_type WHEN 'click' THEN 'Value__c' WHEN 'view' THEN 'K__c' WHEN 'error' THEN '' ELSE 'Value__c,K__c' END"""

DECODED = ("topic", "replay_id", "entity", "change_type", "Value__c", "K__c")


def _landed(spark, sf_dir):
    """Envelopes written as files, as a connector would land them."""
    path = work_dir(spark, "landed")
    domain.envelopes(spark, sf_dir).write.parquet(path)
    return path


@query(
    "change_feed",
    f"WITH {EV} SELECT topic, replay_id, entity, change_type, CASE WHEN raw_value NOT BETWEEN 10 AND 12 THEN Value__c END AS Value__c, "
    f"CASE WHEN raw_value NOT BETWEEN 10 AND 12 THEN K__c END AS K__c FROM ev WHERE ({REASON}) IS NULL",
)
def change_feed(spark, sf_dir):
    stream = feed.read_envelopes(spark, _landed(spark, sf_dir), max_files=4)
    topics = domain.with_topic(domain.change_events(spark, sf_dir)).select("topic")
    decoded = feed.decode_events(feed.split_envelopes(feed.only_topics(stream, topics)), domain.PAYLOAD)
    good, _ = delta.split_dead_letters(decoded)
    out = work_dir(spark, "change_feed")
    return streams.run_to_table(good.select(*DECODED), out, out + "-checkpoint")


@query(
    "envelope_split",
    f"WITH {EV} SELECT topic, replay_id, CASE WHEN raw_value >= 2 THEN 'S-' || entity END AS schema_id, "
    f"CASE WHEN raw_value < 2 THEN 'schema_id_missing' WHEN raw_value < 4 THEN 'payload_missing' END AS reason FROM ev",
)
def envelope_split(spark, sf_dir):
    return feed.split_envelopes(domain.envelopes(spark, sf_dir)).drop("payload")


@query(
    "payload_decode",
    f"WITH {EV} SELECT replay_id, commit_ts, raw_value BETWEEN 6 AND 7.99 AS headless, "
    f"CASE WHEN raw_value NOT BETWEEN 10 AND 12 THEN Value__c END AS Value__c, CASE WHEN raw_value NOT BETWEEN 10 AND 12 THEN K__c END AS K__c "
    f"FROM ev WHERE raw_value >= 6",
)
def payload_decode(spark, sf_dir):
    events = domain.wire_events(spark, sf_dir).select("replay_id", F.col("event.schema_id").alias("schema_id"), F.col("event.payload").alias("payload"))
    decoded = feed.with_record(events.filter(F.col("schema_id").isNotNull()), domain.PAYLOAD, out="r").filter(F.col("r").isNotNull())
    return decoded.select("replay_id", "r.commit_ts", F.col("r.ChangeEventHeader").isNull().alias("headless"), "r.Value__c", "r.K__c")


@query(
    "cdc_header",
    """SELECT event_id AS replay_id, CASE WHEN event_type = 'error' THEN 'Unknown' ELSE 'User' END AS entity, CAST(user_id AS VARCHAR) AS first_id,
    CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END AS n_changed FROM events""",
)
def cdc_header(spark, sf_dir):
    e = domain.table(spark, sf_dir, "events")
    header = F.struct(
        F.when(F.col("event_type") != "error", F.lit("User")).alias("entityName"),
        F.array(F.col("user_id").cast("string")).alias("recordIds"),
        F.when(F.col("event_type") != "signup", F.array("event_type")).alias("changedFields"),
    )
    fields = delta.header_fields(e.select("event_id", header.alias("ChangeEventHeader")))
    return fields.select(F.col("event_id").alias("replay_id"), "entity", F.try_element_at("record_ids", F.lit(1)).alias("first_id"), F.size("changed_fields").alias("n_changed"))


@query(
    "cdc_change_type",
    "SELECT event_id AS replay_id, CASE event_type WHEN 'error' THEN 'Unknown' ELSE upper(event_type) END AS change_type FROM events",
)
def cdc_change_type(spark, sf_dir):
    e = domain.table(spark, sf_dir, "events")
    stated = F.when(F.col("event_type") == "error", F.lit("none")).otherwise(F.concat(F.lit("value: "), F.upper("event_type"), F.lit(", value: LATER")))
    text = e.select(F.col("event_id").alias("replay_id"), F.concat(F.lit("entityName: User, changeType: "), stated, F.lit(" }")).alias("header_text"))
    return delta.with_change_type(text, "header_text").drop("header_text")


@query(
    "cdc_delta_long",
    f"""WITH {EV} SELECT replay_id, 'Value__c' AS field_name, CAST(Value__c AS VARCHAR) AS field_value, 'Number' AS data_type FROM ev WHERE Value__c IS NOT NULL
    UNION ALL SELECT replay_id, 'K__c', CAST(K__c AS VARCHAR), 'Unknown' FROM ev WHERE K__c IS NOT NULL""",
)
def cdc_delta_long(spark, sf_dir):
    return delta.delta_long(domain.change_events(spark, sf_dir), list(domain.DATA_FIELDS), ["replay_id"], {"Value__c": "Number"})


@query(
    "cdc_field_filter",
    f"""WITH {EV} SELECT replay_id, topic, 'Value__c' AS field_name, CAST(Value__c AS VARCHAR) AS field_value FROM ev WHERE Value__c IS NOT NULL AND entity <> 'Order__c'
    UNION ALL SELECT replay_id, topic, 'K__c', CAST(K__c AS VARCHAR) FROM ev WHERE K__c IS NOT NULL""",
)
def cdc_field_filter(spark, sf_dir):
    events = domain.with_topic(domain.change_events(spark, sf_dir))
    changes = delta.delta_long(events, list(domain.DATA_FIELDS), ["replay_id", "topic"]).drop("data_type")
    listed = F.when(F.col("entity") == "Order__c", F.array(F.lit("K__c"))).when(F.col("entity") == "Account", F.array().cast("array<string>"))
    filters = events.select("topic", "entity").distinct().select("topic", listed.alias("fields"))
    return delta.keep_fields(changes, filters)


@query(
    "cdc_type_tag",
    """SELECT p_partkey, CASE WHEN p_size = 1 THEN 'Unknown' WHEN p_size = 2 THEN p_name WHEN p_size = 3 THEN '' ELSE p_type END AS data_type FROM part""",
)
def cdc_type_tag(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    size = F.col("p_size")
    doc = F.when(size == 2, F.col("p_name")).when(size == 3, F.lit("Data:")).when(size > 3, F.concat(F.lit("Data:"), "p_name", F.lit(":"), "p_type"))
    return p.select("p_partkey", type_tag(doc).alias("data_type"))


@query(
    "cdc_id_row",
    f"""WITH {EV} SELECT replay_id, 'Value__c' AS field_name, CAST(Value__c AS VARCHAR) AS field_value, 'Unknown' AS data_type FROM ev WHERE Value__c IS NOT NULL
    UNION ALL SELECT replay_id, 'K__c', CAST(K__c AS VARCHAR), 'Unknown' FROM ev WHERE K__c IS NOT NULL
    UNION ALL SELECT replay_id, 'Id', record_id, 'Id' FROM ev""",
)
def cdc_id_row(spark, sf_dir):
    events = domain.change_events(spark, sf_dir)
    return delta.with_id_rows(delta.delta_long(events, list(domain.DATA_FIELDS), ["replay_id"]), events, ["replay_id"])


@query(
    "cdc_fanout",
    """SELECT o_orderkey AS replay_id, 'C' || o_custkey AS record_id FROM orders
    UNION ALL SELECT o_orderkey, 'O' || o_orderkey FROM orders""",
)
def cdc_fanout(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders")
    ids = F.array(F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")))
    return delta.fan_out(o.select(F.col("o_orderkey").alias("replay_id"), ids.alias("record_ids"))).select("replay_id", "record_id")


@query("cdc_delete_delta", f"WITH {EV} SELECT replay_id, entity, record_id FROM ev WHERE change_type = 'DELETE'")
def cdc_delete_delta(spark, sf_dir):
    return delta.delete_delta(domain.change_events(spark, sf_dir).drop("record_id"))


@query(
    "cdc_transpose",
    f"""WITH {EV} SELECT replay_id, record_id AS Id,
    CASE WHEN event_type = 'purchase' THEN 'late' ELSE CAST(Value__c AS VARCHAR) END AS Value__c, CAST(K__c AS VARCHAR) AS K__c,
    strftime(date_trunc('second', commit_ts), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST((epoch_us(commit_ts) // 1000) % 1000 AS VARCHAR), 3, '0') || '0000Z' AS At__c FROM ev""",
)
def cdc_transpose(spark, sf_dir):
    events = domain.change_events(spark, sf_dir)
    at = F.unix_millis(F.col("commit_ts").cast("timestamp"))
    base = delta.delta_long(events.withColumn("At__c", at), ["Value__c", "K__c", "At__c"], ["replay_id"], {"At__c": "DateTime"})
    rows = delta.with_id_rows(base, events, ["replay_id"]).withColumn("seq", F.lit(0))
    repeated = events.filter(F.size("changed_fields") == 2).filter(F.col("change_type") == "UPDATE")
    again = repeated.select("replay_id", F.lit("Value__c").alias("field_name"), F.lit("late").alias("field_value"), F.lit("Unknown").alias("data_type"), F.lit(1).alias("seq"))
    return delta.long_to_wide(rows.unionByName(again), ["replay_id"], ["Id", "Value__c", "K__c", "At__c"], ["seq"])


@query(
    "cdc_route",
    f"""WITH {EV} SELECT replay_id, CASE WHEN raw_value < 50 THEN 'GAP' WHEN raw_value < 60 THEN 'Insert' ELSE change_type END AS change_type,
    CASE WHEN raw_value < 50 THEN NULL WHEN raw_value < 60 THEN 'upsert' WHEN change_type = 'DELETE' THEN 'delete' ELSE 'upsert' END AS route FROM ev""",
)
def cdc_route(spark, sf_dir):
    e = domain.table(spark, sf_dir, "events")
    kind = domain.choose(F.col("event_type"), {"signup": "CREATE", "error": "DELETE"}, "UPDATE")
    named = F.when(F.col("value") < 50, F.lit("GAP")).when(F.col("value") < 60, F.lit("Insert")).otherwise(kind)
    return delta.route(e.select(F.col("event_id").alias("replay_id"), named.alias("change_type")))


def _customers(spark, sf_dir):
    return domain.table(spark, sf_dir, "customer")


def _keyed(events):
    return events.withColumn("c_custkey", F.col("record_id").cast("bigint"))


@query(
    "cdc_create",
    "SELECT * FROM customer c WHERE c_acctbal < 0 AND EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey AND event_type = 'signup')",
)
def cdc_create(spark, sf_dir):
    image = _customers(spark, sf_dir)
    replica = image.filter(F.col("c_acctbal") >= 0)
    creates = _keyed(domain.change_events(spark, sf_dir)).filter(F.col("change_type") == "CREATE")
    return apply.create_missing(replica, image, creates, "c_custkey")


@query(
    "cdc_partial_update",
    """SELECT c_custkey, c_name,
      coalesce((SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) FROM events e WHERE e.user_id = c.c_custkey AND event_type IN ('view','purchase') ORDER BY ts DESC, event_id DESC LIMIT 1), c_nationkey) AS c_nationkey,
      coalesce((SELECT value FROM events e WHERE e.user_id = c.c_custkey AND event_type IN ('click','purchase') ORDER BY ts DESC, event_id DESC LIMIT 1), c_acctbal) AS c_acctbal,
      c_mktsegment FROM customer c""",
)
def cdc_partial_update(spark, sf_dir):
    base = apply.base_as_changes(_customers(spark, sf_dir), _before_all())
    updates = _field_updates(spark, sf_dir).filter(F.col("change_type") == "UPDATE")
    folded = apply.fold_changes(base.unionByName(updates, allowMissingColumns=True), ["c_custkey"], ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return folded.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _before_all():
    return {"commit_ts": F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"), "replay_id": F.lit(-1).cast("bigint")}


def _field_updates(spark, sf_dir):
    """Change events in the columns of the customer replica."""
    e = _keyed(domain.change_events(spark, sf_dir))
    renamed = F.transform("changed_fields", lambda f: F.when(f == "Value__c", F.lit("c_acctbal")).otherwise(F.lit("c_nationkey")))
    return e.select("c_custkey", "commit_ts", "replay_id", "change_type", renamed.alias("changed_fields"), F.col("Value__c").alias("c_acctbal"), F.col("K__c").alias("c_nationkey"))


FOLDED = """WITH r AS (SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('signup','error')) WHERE n = 1),
    v AS (SELECT r.user_id, e.value, row_number() OVER (PARTITION BY r.user_id ORDER BY e.ts DESC, e.event_id DESC) AS n FROM r JOIN events e ON e.user_id = r.user_id AND (e.ts, e.event_id) >= (r.ts, r.event_id) AND e.event_type IN ('click','purchase','signup')),
    k AS (SELECT r.user_id, CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k, row_number() OVER (PARTITION BY r.user_id ORDER BY e.ts DESC, e.event_id DESC) AS n FROM r JOIN events e ON e.user_id = r.user_id AND (e.ts, e.event_id) >= (r.ts, r.event_id) AND e.event_type IN ('view','purchase','signup'))
    SELECT CAST(r.user_id AS VARCHAR) AS record_id, v.value AS Value__c, k.k AS K__c FROM r JOIN v ON v.user_id = r.user_id AND v.n = 1 JOIN k ON k.user_id = r.user_id AND k.n = 1 WHERE r.event_type = 'signup'"""


@query("cdc_fold_changes", FOLDED)
def cdc_fold_changes(spark, sf_dir):
    folded = apply.fold_changes(domain.change_events(spark, sf_dir), ["record_id"], ["Value__c", "K__c"])
    return folded.select("record_id", "Value__c", "K__c")


@query(
    "cdc_update_in_place",
    """WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('click','view','purchase')) WHERE n = 1)
    SELECT c_custkey, c_name, CASE WHEN event_type IN ('view','purchase') THEN CAST(json_extract_string(props, '$.k') AS INTEGER) ELSE c_nationkey END AS c_nationkey,
    CASE WHEN event_type IN ('click','purchase') THEN value ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer LEFT JOIN u ON user_id = c_custkey""",
)
def cdc_update_in_place(spark, sf_dir):
    updates = _field_updates(spark, sf_dir).filter(F.col("change_type") == "UPDATE")
    last = apply.latest_state(updates, ["c_custkey"], ["changed_fields", "c_acctbal", "c_nationkey"])
    return apply.partial_update(_customers(spark, sf_dir), last, "c_custkey", ["c_acctbal", "c_nationkey"])


@query(
    "cdc_replace",
    """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey IN (SELECT user_id FROM events WHERE event_type IN ('click','view','purchase')) THEN c_acctbal ELSE 0 END AS c_acctbal, c_mktsegment FROM customer""",
)
def cdc_replace(spark, sf_dir):
    image = _customers(spark, sf_dir)
    stale = image.withColumn("c_acctbal", F.lit(0.0))
    changed = _keyed(domain.change_events(spark, sf_dir)).filter(F.col("change_type") == "UPDATE")
    return apply.replace_rows(stale, image, changed, "c_custkey")


@query("cdc_delete", "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def cdc_delete(spark, sf_dir):
    deletes = delta.delete_delta(domain.change_events(spark, sf_dir).drop("record_id")).select(F.col("record_id").cast("bigint").alias("c_custkey"))
    return apply.delete_rows(_customers(spark, sf_dir), deletes, "c_custkey")


@query(
    "cdc_exists",
    """SELECT e.event_id AS replay_id, e.user_id AS c_custkey, c.c_custkey IS NOT NULL AS record_exists FROM events e LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON c.c_custkey = e.user_id""",
)
def cdc_exists(spark, sf_dir):
    events = _keyed(domain.change_events(spark, sf_dir)).select("replay_id", "c_custkey")
    replica = _customers(spark, sf_dir).filter(F.col("c_mktsegment") == "BUILDING")
    return apply.mark_existing(events, replica, "c_custkey")


@query("cdc_dead_letter", f"WITH {EV} SELECT topic, replay_id, {REASON} AS reason FROM ev WHERE ({REASON}) IS NOT NULL")
def cdc_dead_letter(spark, sf_dir):
    decoded = feed.decode_events(feed.split_envelopes(domain.envelopes(spark, sf_dir)), domain.PAYLOAD)
    _, bad = delta.split_dead_letters(decoded)
    return bad.select("topic", "replay_id", "reason")


@query(
    "cdc_latest_state",
    f"""SELECT f.*, e.ts AS commit_ts, e.event_id AS replay_id FROM ({FOLDED}) f
    JOIN (SELECT CAST(user_id AS VARCHAR) AS record_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) e ON e.record_id = f.record_id AND e.n = 1""",
)
def cdc_latest_state(spark, sf_dir):
    return apply.fold_changes(domain.change_events(spark, sf_dir), ["record_id"], ["Value__c", "K__c"])


@query(
    "cdc_before_after",
    """WITH u AS (SELECT user_id, CASE WHEN event_type IN ('click','purchase') THEN value END AS v, CASE WHEN event_type IN ('view','purchase') THEN json_extract_string(props, '$.k') END AS k
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('click','view','purchase')) WHERE n = 1)
    SELECT user_id AS c_custkey, 'c_acctbal' AS field_name, CAST(c_acctbal AS VARCHAR) AS before, CAST(v AS VARCHAR) AS after FROM u LEFT JOIN customer ON user_id = c_custkey WHERE CAST(c_acctbal AS VARCHAR) IS DISTINCT FROM CAST(v AS VARCHAR)
    UNION ALL SELECT user_id, 'c_nationkey', CAST(c_nationkey AS VARCHAR), k FROM u LEFT JOIN customer ON user_id = c_custkey WHERE CAST(c_nationkey AS VARCHAR) IS DISTINCT FROM k""",
)
def cdc_before_after(spark, sf_dir):
    updates = _field_updates(spark, sf_dir).filter(F.col("change_type") == "UPDATE")
    last = apply.latest_state(updates, ["c_custkey"], ["c_acctbal", "c_nationkey"])
    return apply.before_after(_customers(spark, sf_dir), last, "c_custkey", ["c_acctbal", "c_nationkey"])


@query(
    "cdc_change_notice",
    """SELECT 'Customer' AS table_name, 'Inserted' AS event, c.* FROM customer c WHERE c_acctbal < 0 AND EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey AND event_type = 'signup')""",
)
def cdc_change_notice(spark, sf_dir):
    return apply.change_notices("Customer", cdc_create(spark, sf_dir))


@query("cdc_audit", f"WITH {EV} SELECT replay_id, change_type, {CHANGED} AS changed_fields, record_id AS record_ids FROM ev")
def cdc_audit(spark, sf_dir):
    return delta.audit(domain.change_events(spark, sf_dir))


@query("topic_set", "SELECT DISTINCT '/data/' || event_type AS topic FROM events")
def topic_set(spark, sf_dir):
    members = domain.table(spark, sf_dir, "events").select(entity_topic(F.col("event_type")).alias("topic"))
    return feed.topic_set(members)


@query(
    "topics_of_objects",
    "SELECT DISTINCT '/data/' || CASE WHEN lower(p_brand) = 'brand#1' THEN p_brand || '__ChangeEvent' ELSE p_brand || 'ChangeEvent' END AS topic FROM part",
)
def topics_of_objects(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    name = F.when(F.col("p_brand") == "Brand#1", F.concat("p_brand", F.lit("__c"))).otherwise(F.col("p_brand"))
    return feed.topic_set(p.select(entity_topic(object_to_event(name)).alias("topic")))


# Schema versions and bitmaps ---------------------------------------------------------------

VERSION_REASON = "CASE replay_id % 5 WHEN 2 THEN 'type_not_promotable:K__c' WHEN 3 THEN 'schema_unreadable' WHEN 4 THEN 'schema_unknown' END"


@query(
    "payload_by_schema",
    f"""WITH {EV} SELECT replay_id, CASE replay_id % 5 WHEN 0 THEN 'S-1-' WHEN 1 THEN 'S-2-' WHEN 2 THEN 'S-3-' WHEN 3 THEN 'S-4-' ELSE 'S-5-' END || entity AS schema_id,
    {VERSION_REASON} AS reason, change_type, CASE WHEN replay_id % 5 < 2 THEN array_to_string(list_sort(string_split({CHANGED}, ',')), ',') ELSE '' END AS changed,
    CASE WHEN replay_id % 5 < 2 THEN Value__c END AS Value__c, CASE WHEN replay_id % 5 < 2 THEN CAST(K__c AS DOUBLE) END AS K__c,
    CASE replay_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'none' END AS Grade__c FROM ev""",
)
def payload_by_schema(spark, sf_dir):
    """Five versions, read as one: a rename, a widening, a default, and three that cannot be read."""
    decoded = schemas.decode_by_schema(domain.versioned_events(spark, sf_dir), domain.version_registry(spark, sf_dir), domain.WANTED)
    changed = F.array_join(F.array_sort("changed_fields"), ",").alias("changed")
    return decoded.select("replay_id", "schema_id", "reason", "change_type", changed, "Value__c", "K__c", "Grade__c")


@query("cdc_changed_bitmap", FOLDED)
def cdc_changed_bitmap(spark, sf_dir):
    """Changed fields as bitmaps over (Id, Name with two parts, Value__c, K__c), folded as the names would be."""
    events = domain.change_events(spark, sf_dir)
    value, k = F.array_contains("changed_fields", "Value__c"), F.array_contains("changed_fields", "K__c")
    bits = F.when(value, F.lit(4)).otherwise(F.lit(0)) + F.when(k, F.lit(8)).otherwise(F.lit(0))
    coded = events.withColumn("changed_fields", F.array(F.concat(F.lit("0x"), F.lpad(F.hex(bits), 2, "0")), F.lit("1-0x02")))
    names = F.array(*[F.lit(n) for n in ("Id", "Name", "Value__c", "K__c")])
    none = F.array().cast("array<string>")
    parts = F.array(none, F.array(F.lit("FirstName"), F.lit("LastName")), none, none)
    named = coded.withColumn("changed_fields", schemas.changed_names(F.col("changed_fields"), names, parts))
    return apply.fold_changes(named, ["record_id"], ["Value__c", "K__c"]).select("record_id", "Value__c", "K__c")


# Wire responses ----------------------------------------------------------------------------


def _wire_responses(spark, sf_dir):
    """The envelopes as JSON responses: replay ids of 8 or 12 bytes, one response in seven cut off."""
    sent = domain.wire_events(spark, sf_dir)
    digits = F.lpad(F.hex("replay_id"), 16, "0")
    octets = F.unhex(F.when(F.col("replay_id") % 2 == 0, digits).otherwise(F.concat(F.lit("00000000"), digits)))
    event = F.struct(F.col("event.id").alias("id"), F.col("event.schema_id").alias("schemaId"), F.col("event.payload").alias("payload"))
    entry = F.struct("replay_id", F.struct(event.alias("event"), F.base64(octets).alias("replayId")).alias("e"))
    page = F.floor(F.col("replay_id") / 10)
    pages = sent.groupBy("topic", page.alias("page")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    events = F.transform("e", lambda x: x["e"])
    text = F.to_json(F.struct(events.alias("events"), F.element_at(events, -1)["replayId"].alias("latestReplayId")))
    return pages.select("topic", F.when(F.col("page") % 7 == 3, F.concat(F.lit("{"), F.col("page").cast("string"))).otherwise(text).alias("value"))


@query(
    "wire_decode",
    f"""WITH {EV}, h AS (SELECT *, hex(replay_id) AS x FROM ev), w AS (SELECT *, replay_id // 10 AS page, CASE WHEN replay_id = 0 THEN '' WHEN length(x) % 2 = 1 THEN '0' || x ELSE x END AS d FROM h),
    bad AS (SELECT DISTINCT topic, page FROM w WHERE page % 7 = 3)
    SELECT topic, printf('%04X', length(d) // 2) || d AS replay_id, entity, change_type, CASE WHEN raw_value NOT BETWEEN 10 AND 12 THEN Value__c END AS Value__c, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS response
    FROM w WHERE page % 7 <> 3 AND ({REASON}) IS NULL
    UNION ALL SELECT topic, printf('%04X', length(d) // 2) || d, CASE WHEN raw_value >= 2 AND raw_value < 8 THEN 'Unknown' ELSE entity END,
      CASE WHEN raw_value >= 2 AND raw_value < 8 THEN 'Unknown' WHEN raw_value >= 8 AND raw_value < 10 THEN 'GAP_CREATE' ELSE change_type END,
      CASE WHEN raw_value < 2 OR raw_value >= 6 AND raw_value NOT BETWEEN 10 AND 12 THEN Value__c END, {REASON}, NULL FROM w WHERE page % 7 <> 3 AND ({REASON}) IS NOT NULL
    UNION ALL SELECT topic, NULL, 'Unknown', 'Unknown', NULL, 'response_unreadable', '{{' || page FROM bad""",
)
def wire_decode(spark, sf_dir):
    """Every event of every response, and every response that cannot be read: applied or refused, none lost."""
    decoded = feed.decode_events(feed.split_envelopes(feed.wire_envelopes(_wire_responses(spark, sf_dir))), domain.PAYLOAD)
    return decoded.select("topic", "replay_id", "entity", "change_type", "Value__c", "reason", "response")
