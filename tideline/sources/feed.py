"""Change feed: envelopes of events, their split and the payload decode.

An envelope row is one fetched batch of a topic.  Payloads are base64 text of a
JSON record whose fields come with the schema registry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import is_blank
from ..functions.text import UNKNOWN
from ..operators.delta import dead_letter_reason, header_fields
from ..operators.keys import small_side
from ..functions.once import computed_once

EVENT_DDL = "struct<id:string,schema_id:string,payload:string,headers:array<struct<key:string,value:binary>>>"
ENVELOPE_DDL = f"topic string, latest_replay_id bigint, events array<struct<event:{EVENT_DDL},replay_id:bigint>>"

SCHEMA_MISSING = "schema_id_missing"
PAYLOAD_MISSING = "payload_missing"
REPLAY_ID_MISSING = "replay_id_missing"
RESPONSE_UNREADABLE = "response_unreadable"
WIRE_EVENTS = f"array<struct<event:{EVENT_DDL},replay_id:string>>"


def topic_set(topics: DataFrame, topic: str = "topic") -> DataFrame:
    """Topics to subscribe to: blank ones skipped, repeats once."""
    return topics.filter(~is_blank(F.col(topic))).select(topic).distinct()


def read_envelopes(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream over landed envelope files; ``max_files`` per trigger is the flow control."""
    reader = spark.readStream.schema(ENVELOPE_DDL)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def replay_order(replay_id: Column) -> Column:
    """Opaque replay bytes as text that sorts as the number they write, whatever their length.

    The text is the count of significant bytes in four hexadecimal digits, then
    those bytes: leading zero bytes make no difference, nothing can overflow.
    """
    digits = F.regexp_replace(F.hex(replay_id), "^(00)+", "")
    return F.concat(F.lpad(F.hex((F.length(digits) / 2).cast("bigint")), 4, "0"), digits)


def replay_number(order: Column) -> Column:
    """The number behind an ordered replay text; NULL where it is no long."""
    digits = F.substring(order, 5, 1 << 20)
    fits = (F.length(digits) < 16) | ((F.length(digits) == 16) & (digits < "8"))
    return F.when(fits, F.conv(F.concat(F.lit("0"), digits), 16, 10).try_cast("bigint"))


def wire_envelopes(rows: DataFrame, text: str = "value", topic: str = "topic") -> DataFrame:
    """Envelopes out of responses in the bus's JSON form, as Kafka rows or text files hold them.

    Replay ids become ordered text (``replay_order``).  A response that cannot be
    read is an envelope with a ``reason`` and its text in ``response``; splitting
    makes it a row of its own, so that it ends among the dead letters.
    """
    event = "struct<id:string,schemaId:string,payload:string>"
    shape = f"struct<events:array<struct<event:{event},replayId:string>>,latestReplayId:string,_unread:string>"
    body = F.from_json("response", shape, {"columnNameOfCorruptRecord": "_unread"})
    number = lambda replay_id: replay_order(F.try_to_binary(replay_id, F.lit("base64")))
    none = F.array().cast("array<struct<key:string,value:binary>>")
    unread = F.col("b").isNull() | F.col("b._unread").isNotNull()
    return computed_once(rows.select(F.col(topic).alias("topic"), F.col(text).cast("string").alias("response")), "b", body).select(
        "topic",
        number(F.col("b.latestReplayId")).alias("latest_replay_id"),
        F.when(unread, F.array().cast(WIRE_EVENTS)).otherwise(
            F.transform(
                "b.events",
                lambda e: F.struct(
                    F.struct(
                        e["event"]["id"].alias("id"),
                        e["event"]["schemaId"].alias("schema_id"),
                        e["event"]["payload"].alias("payload"),
                        none.alias("headers"),
                    ).alias("event"),
                    number(e["replayId"]).alias("replay_id"),
                ),
            )
        ).alias("events"),
        F.when(unread, F.lit(RESPONSE_UNREADABLE)).alias("reason"),
        F.when(unread, F.col("response")).alias("response"),
    )


def parse_wire(rows: DataFrame, text: str = "value", topic: str = "topic") -> DataFrame:
    """``wire_envelopes`` with replay ids as numbers, for buses whose ids are longs; another id is NULL."""
    found = wire_envelopes(rows, text, topic)
    events = F.transform("events", lambda e: F.struct(e["event"].alias("event"), replay_number(e["replay_id"]).alias("replay_id")))
    return found.select("topic", replay_number(F.col("latest_replay_id")).alias("latest_replay_id"), events.alias("events"))


def only_topics(envelopes: DataFrame, topics: DataFrame) -> DataFrame:
    """Envelopes of the subscribed topics."""
    return envelopes.join(small_side(topic_set(topics)), "topic", "left_semi")


def split_envelopes(envelopes: DataFrame) -> DataFrame:
    """One row per event; ``reason`` is set where the event lacks schema, payload or place.

    An empty envelope is a keepalive and gives no row.  An envelope refused as a
    whole (``reason`` is set, as by ``parse_wire``) is one row with its ``response``.
    """
    refused = "reason" in envelopes.columns
    kind = envelopes.schema["events"].dataType
    events = F.when(F.col("reason").isNotNull(), F.array(F.lit(None).cast(kind.elementType))).otherwise(F.col("events")) if refused else F.col("events")
    more = ["response", F.col("reason").alias("_refused")] if refused else []
    rows = envelopes.select("topic", F.explode(events).alias("e"), *more).select(
        "topic",
        F.col("e.replay_id").alias("replay_id"),
        F.col("e.event.schema_id").alias("schema_id"),
        F.col("e.event.payload").alias("payload"),
        *(["response", "_refused"] if refused else []),
    )
    reason = (
        F.when(F.col("schema_id").isNull(), F.lit(SCHEMA_MISSING))
        .when(F.col("payload").isNull(), F.lit(PAYLOAD_MISSING))
        .when(F.col("replay_id").isNull(), F.lit(REPLAY_ID_MISSING))
    )
    return rows.withColumn("reason", F.coalesce("_refused", reason) if refused else reason).drop("_refused")


def payload_schema(fields: dict[str, T.DataType]) -> T.StructType:
    """Payload record: header, commit time and the object's fields."""
    texts = T.ArrayType(T.StringType())
    header = T.StructType().add("entityName", T.StringType()).add("changeType", T.StringType()).add("recordIds", texts).add("changedFields", texts)
    record = T.StructType().add("ChangeEventHeader", header).add("commit_ts", T.TimestampNTZType())
    for name, kind in fields.items():
        record = record.add(name, kind)
    return record


def with_record(events: DataFrame, schema: T.StructType, payload: str = "payload", out: str = "record") -> DataFrame:
    """Adds the record in a base64 JSON payload, NULL when it cannot be read."""
    text = F.try_to_binary(payload, F.lit("base64")).cast("string")
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = computed_once(events, "_parsed", F.from_json(text, corrupt, {"columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.withColumn(out, F.when(F.col("_parsed._corrupt").isNull(), F.col("_parsed"))).drop("_parsed")


def with_avro_record(events: DataFrame, avro_schema: str, payload: str = "payload", out: str = "record") -> DataFrame:
    """The same for Avro payloads of one schema; needs Spark's Avro module on the class path."""
    from pyspark.sql.avro.functions import from_avro

    binary = F.try_to_binary(payload, F.lit("base64"))
    return computed_once(events, out, from_avro(binary, avro_schema, {"mode": "PERMISSIVE"}))


def decode_events(events: DataFrame, schema: T.StructType) -> DataFrame:
    """Header, change type and field columns of split events, with the refusal reason."""
    data = [f.name for f in schema.fields if f.name not in ("ChangeEventHeader", "commit_ts")]
    flat = with_record(events, schema, out="_r").select(
        *[c for c in events.columns if c not in ("payload", "reason")],
        F.col("reason").alias("_split_reason"),
        F.col("_r").isNotNull().alias("_decoded"),
        F.col("_r.ChangeEventHeader").alias("ChangeEventHeader"),
        *[F.col(f"_r.{f}").alias(f) for f in ("commit_ts", *data)],
    )
    named = header_fields(flat).withColumn("change_type", F.coalesce(F.col("ChangeEventHeader.changeType"), F.lit(UNKNOWN)))
    filled = sum((F.col(f).isNotNull().cast("int") for f in data), F.lit(0))
    touched = F.size(F.array_intersect("changed_fields", F.array(*[F.lit(f) for f in data])))
    reason = dead_letter_reason(F.col("ChangeEventHeader"), F.col("_decoded"), F.col("change_type"), filled + touched, F.col("record_ids"))
    return named.withColumn("reason", F.coalesce("_split_reason", reason)).drop("_split_reason", "_decoded", "ChangeEventHeader")


def join_schemas(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds the registered schema text of each event; the registry has a row per schema version."""
    return events.join(small_side(registry.select("schema_id", "schema_json")), "schema_id", "left")


def start_after(events: DataFrame, replay_id: int | None, column: str = "replay_id") -> DataFrame:
    """Events after a stored replay id; None means from the earliest."""
    return events if replay_id is None else events.filter(F.col(column) > replay_id)


def tip_of(envelopes: DataFrame) -> int | None:
    """Latest replay id landed so far: start after it to see only new events."""
    return envelopes.agg(F.max("latest_replay_id")).first()[0]


def pack_envelopes(events: DataFrame, topic: str, order: Sequence[str], batch_of: Column, size: int = 10) -> DataFrame:
    """Envelopes as the bus would send them; ``batch_of`` numbers batches of ``size`` events."""
    entry = F.struct(*order, F.struct("event", "replay_id").alias("entry"))
    grouped = events.groupBy(F.col(topic).alias("topic"), batch_of.alias("_batch")).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    return grouped.select("topic", F.transform("_e", lambda e: e["entry"]).alias("events")).select(
        "topic", F.element_at("events", -1)["replay_id"].alias("latest_replay_id"), "events"
    )
