from __future__ import annotations

import datetime as dt
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import apply, delta
from tideline.sources import feed

from .conftest import rows

EVENTS = "record_id string, commit_ts timestamp_ntz, replay_id bigint, change_type string, changed_fields array<string>, a int, b string"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)


def fold_by_hand(events):
    """Row by row, as one table would take the events."""
    table = {}
    for rid, _, _, kind, changed, a, b in sorted(events, key=lambda e: (e[1], e[2])):
        if kind.upper() == "DELETE":
            table.pop(rid, None)
        elif kind.upper() in ("CREATE", "INSERT"):
            table[rid] = {"a": a, "b": b}
        elif rid in table:
            for f in changed:
                table[rid][f] = {"a": a, "b": b}[f]
    return sorted((k, v["a"], v["b"]) for k, v in table.items())


def one_event(n):
    kinds = st.sampled_from(["CREATE", "Insert", "UPDATE", "UPDATE", "UPDATE", "delete"])
    fields = st.lists(st.sampled_from(["a", "b"]), unique=True)
    return st.tuples(st.sampled_from(["r1", "r2", "r3"]), st.integers(0, 5), kinds, fields, st.none() | st.integers(0, 9), st.none() | st.sampled_from("xyz"))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(drawn=st.lists(one_event(0), min_size=1, max_size=25), seed=st.integers(0, 99))
def test_fold_equals_row_by_row(spark, drawn, seed):
    events = [(r, at(t), i, k, c, a, b) for i, (r, t, k, c, a, b) in enumerate(drawn)]
    shuffled = list(events)
    random.Random(seed).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, EVENTS).repartition(3)
    folded = apply.fold_changes(df, ["record_id"], ["a", "b"]).select("record_id", "a", "b")
    got = sorted(((r[0], r[1], r[2]) for r in folded.collect()), key=lambda t: t[0])
    assert got == fold_by_hand(events)
    # Applying everything twice changes nothing.
    again = apply.fold_changes(df.unionByName(df), ["record_id"], ["a", "b"]).select("record_id", "a", "b")
    assert rows(again) == rows(folded)


def test_explicit_null_overrides(spark):
    events = [("r", at(0), 1, "CREATE", [], 1, "x"), ("r", at(1), 2, "UPDATE", ["a"], None, None)]
    assert rows(apply.fold_changes(spark.createDataFrame(events, EVENTS), ["record_id"], ["a", "b"]), "record_id", "a", "b") == [("r", None, "x")]


def test_latest_state_ties_and_recreate(spark):
    events = [
        ("r", at(0), 1, "DELETE", [], 1, "x"),
        ("r", at(0), 2, "CREATE", [], 2, "y"),
        ("s", at(3), 3, "CREATE", [], 3, "z"),
        ("s", at(3), 4, "DELETE", [], None, None),
    ]
    df = spark.createDataFrame(events, EVENTS)
    assert rows(apply.latest_state(df, ["record_id"], ["a", "b"]), "record_id", "a", "b") == [("r", 2, "y")]
    kept = apply.latest_state(df, ["record_id"], ["a"], keep_deleted=True)
    assert rows(kept, "record_id", "change_type") == [("r", "CREATE"), ("s", "DELETE")]


def test_fan_out(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["c"])], "replay_id int, record_ids array<string>")
    assert rows(delta.fan_out(df), "replay_id", "record_id") == [(1, "a"), (1, "b"), (3, "c")]
    assert rows(delta.fan_out(df, first_only=True), "replay_id", "record_id") == [(1, "a"), (3, "c")]


def test_long_to_wide_round_trip(spark):
    df = spark.createDataFrame([(1, "a", None, "1"), (2, None, "b", "2"), (3, None, None, None)], "k int, x string, y string, z string")
    long = delta.delta_long(df, ["x", "y", "z"], ["k"]).withColumn("seq", F.lit(0))
    assert rows(delta.long_to_wide(long, ["k"], ["x", "y", "z"], ["seq"])) == rows(df.filter("k < 3"))


def test_wide_duplicates_blanks_and_dates(spark):
    data = [
        (1, "x", "old", "Text", 1),
        (1, "x", "new", "Text", 2),
        (1, "", "lost", "Text", 3),
        (1, "t", "0", "DateTime", 4),
        (1, "u", "0", "Text", 5),
        (2, "t", "soon", "DateTime", 1),
    ]
    df = spark.createDataFrame(data, "k int, field_name string, field_value string, data_type string, seq int")
    assert rows(delta.long_to_wide(df, ["k"], ["x", "t", "u"], ["seq"])) == [(1, "new", "1970-01-01T00:00:00.0000000Z", "0"), (2, None, "soon", None)]


def test_field_filter(spark):
    df = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t2", "a"), ("t3", "b")], "topic string, field_name string")
    filters = spark.createDataFrame([("t1", ["b"]), ("t2", [])], "topic string, fields array<string>")
    assert rows(delta.keep_fields(df, filters)) == [("t1", "b"), ("t2", "a"), ("t3", "b")]


def test_partial_update_keeps_key_and_absent_rows(spark):
    replica = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, n int")
    updates = spark.createDataFrame([(1, ["name"], None, 9), (3, ["n"], "c", 3)], "id int, changed_fields array<string>, name string, n int")
    assert rows(apply.partial_update(replica, updates, "id", ["name", "n"])) == [(1, None, 1), (2, "b", 2)]


def test_create_only_if_absent(spark):
    image = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    creates = spark.createDataFrame([(1,), (2,), (2,), (9,)], "id int")
    assert rows(apply.create_missing(image.filter("id = 1"), image, creates, "id")) == [(2, "b")]


def test_route_and_dead_letters(spark):
    df = spark.createDataFrame([("create",), ("INSERT",), ("Update",), ("DELETE",), ("GAP_CREATE",), (None,)], "change_type string")
    assert [r["route"] for r in delta.route(df).collect()] == ["upsert", "upsert", "upsert", "delete", None, None]


def test_envelope_edges(spark):
    event = "struct<id:string,schema_id:string,payload:string,headers:array<struct<key:string,value:binary>>>"
    good = ("1", "S", "eyJDaGFuZ2VFdmVudEhlYWRlciI6eyJlbnRpdHlOYW1lIjoiQSIsImNoYW5nZVR5cGUiOiJDUkVBVEUiLCJyZWNvcmRJZHMiOlsieCIsInkiXX0sIlZhbHVlX19jIjoxLjV9", [])
    data = [("t", [(good, 1), (("2", None, "x", []), 2), (("3", "S", None, []), 3), (("4", "S", "%%%", []), 4)]), ("t", []), ("u", None)]
    df = spark.createDataFrame(data, f"topic string, events array<struct<event:{event},replay_id:bigint>>")
    decoded = feed.decode_events(feed.split_envelopes(df), feed.payload_schema({"Value__c": T.DoubleType()}))
    assert rows(decoded, "replay_id", "entity", "change_type", "Value__c", "reason") == [
        (1, "A", "CREATE", 1.5, None),
        (2, "Unknown", "Unknown", None, "schema_id_missing"),
        (3, "Unknown", "Unknown", None, "payload_missing"),
        (4, "Unknown", "Unknown", None, "decode_failed"),
    ]
    assert rows(delta.fan_out(decoded.filter("reason is null")), "record_id") == [("x",), ("y",)]


def test_wire_json(spark):
    text = '{"events":[{"event":{"id":"e","schemaId":"S","payload":"cA=="},"replayId":"AAAAAAAAAQI="},{"event":{"id":"f"}}],"latestReplayId":"AAAAAAAAAQM="}'
    df = spark.createDataFrame([("t", text), ("t", '{"latestReplayId":"AAAAAAAAAQQ="}'), ("t", "broken")], "topic string, value string")
    envelopes = feed.parse_wire(df)
    assert rows(envelopes, "latest_replay_id") == [(259,), (260,), (None,)]
    assert feed.tip_of(envelopes) == 260
    assert rows(feed.split_envelopes(envelopes)) == [
        ("t", 258, "S", "cA==", None),
        ("t", None, None, None, "schema_id_missing"),
    ]


def test_topic_set(spark):
    df = spark.createDataFrame([("a",), ("a",), ("",), ("  ",), (None,)], "topic string")
    assert rows(feed.topic_set(df)) == [("a",)]


def test_untouched_fields_keep_their_value(spark):
    """CREATE(a=5, b=3), then UPDATE of a only; and an event that names no record."""
    from tideline.operators import delta

    ddl = "record_id string, commit_ts timestamp, replay_id bigint, change_type string, changed_fields array<string>, a int, b int"
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("r", day, 1, "CREATE", [], 5, 3), ("r", day, 2, "UPDATE", ["a"], 7, None)], ddl)
    assert rows(apply.fold_changes(df, ["record_id"], ["a", "b"]), "a", "b", "replay_id") == [(7, 3, 2)]
    ids = spark.createDataFrame([([],), (None,), ([None],), (["x", None],)], "record_ids array<string>")
    reason = delta.dead_letter_reason(F.lit("header"), F.lit(True), F.lit("UPDATE"), F.lit(1), F.col("record_ids"))
    assert [r["reason"] for r in ids.select(reason.alias("reason")).collect()] == [delta.NO_RECORD] * 3 + [None]
    assert rows(delta.fan_out(ids.filter("size(record_ids) = 2")), "record_id") == [("x",)]


def test_replay_ids_sort_as_numbers_and_never_overflow(spark):
    import random

    chance = random.Random(2)
    given = [b"", b"\x00", b"\x01", b"\xff" * 8, b"\x00" * 4 + b"\xff" * 8, b"\x01" + b"\x00" * 11, b"\xff" * 300]
    given += [chance.randbytes(chance.randint(1, 14)) for _ in range(200)] + [None]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, b binary")
    order = feed.replay_order(F.col("b"))
    found = {r["i"]: (r["o"], r["n"]) for r in df.select("i", order.alias("o"), feed.replay_number(order).alias("n")).collect()}
    value = lambda b: int.from_bytes(b, "big")
    whole = [i for i, g in enumerate(given) if g is not None]
    assert sorted(whole, key=lambda i: (found[i][0], i)) == sorted(whole, key=lambda i: (value(given[i]), i))
    assert all(found[i][1] == (value(given[i]) if value(given[i]) < 2**63 else None) for i in whole)
    assert found[len(given) - 1] == (None, None)


def test_no_event_of_a_wire_response_is_lost(spark):
    """Rows in are applied or refused: events of good responses, and each response that cannot be read."""
    good = '{"events":[{"event":{"id":"e","schemaId":"S","payload":"cA=="},"replayId":"//////////8="},{"event":{"id":"f","schemaId":"S","payload":"cA=="}},{"event":null,"replayId":"AQ=="}],"latestReplayId":"AQ=="}'
    texts = [good, '{"latestReplayId":"AQ=="}', '{"events":[]}', "broken", "", None, '{"events":7}', "[1]"]
    df = spark.createDataFrame([("t", t) for t in texts], "topic string, value string")
    split = feed.split_envelopes(feed.wire_envelopes(df))
    reasons = [r["reason"] for r in split.orderBy(F.col("reason").asc_nulls_first()).collect()]
    assert reasons == [None, "replay_id_missing"] + ["response_unreadable"] * 5 + ["schema_id_missing"]
    assert rows(split.filter("reason is null"), "replay_id") == [("0008FFFFFFFFFFFFFFFF",)]
    assert {r["response"] for r in split.filter("reason = 'response_unreadable'").collect()} == {"broken", "", None, '{"events":7}', "[1]"}
    assert feed.parse_wire(df).filter("latest_replay_id = 1").count() == 2
