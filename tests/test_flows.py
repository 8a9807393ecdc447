"""Flows over several runs or rounds: cascades, control numbers, the order trigger, refused documents."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import cascade, edi, registry
from tideline.sources import json_docs, xml_docs
from tideline.streaming import orders as order_trigger
from tideline.streaming.replica import ReplicaLog

from .conftest import rows

# ------------------------------------------------------------ cascade


def test_a_cycle_ends_and_other_pointers_are_cleared(spark):
    people = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 4), (5, None), (None, 1)], "id int, boss int")
    notes = spark.createDataFrame([("a", 1), ("b", 5), ("c", None)], "note string, about int")
    tables, ids = {"Person": people, "Note": notes}, {"Person": "id", "Note": "note"}
    relations = [cascade.Relation("Person", "Person", "boss"), cascade.Relation("Person", "Note", "about", cascade=False)]
    deletes = spark.createDataFrame([("Person", "2"), ("Person", "9"), ("Person", "2")], "entity string, record_id string")
    gone = cascade.cascaded(deletes, cascade.relation_links(tables, ids, relations))
    assert rows(gone) == [("Person", "1"), ("Person", "2"), ("Person", "3"), ("Person", "9")]
    left = cascade.delete_cascading(tables, ids, relations, deletes)
    assert rows(left["Person"]) == [(4, 4), (5, None), (None, 1)]
    assert rows(left["Note"]) == [("a", None), ("b", 5), ("c", None)]


def test_no_deletes_and_no_relations(spark):
    t = spark.createDataFrame([(1, 1)], "id int, up int")
    none = spark.createDataFrame([], "entity string, record_id string")
    links = cascade.relation_links({"T": t}, {"T": "id"}, [cascade.Relation("T", "T", "up")])
    assert cascade.cascaded(none, links).count() == 0
    with pytest.raises(ValueError, match="cascades"):
        cascade.relation_links({"T": t}, {"T": "id"}, [])


# ------------------------------------------------------------ control numbers


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_numbers_are_gapless_across_runs_and_repeats(spark, tmp_path, hot_rows):
    def documents(n):
        return spark.createDataFrame([(i, "S", "R1" if i % 3 else None, i % 4) for i in range(n)], "doc int, s string, r string, day int").repartition(3)

    allot = lambda n, run: edi.allot_control_numbers(documents(n), ["s", "r"], ["doc"], [F.col("day")], str(tmp_path / "ledger"), run, hot_rows)
    first = rows(allot(20, 0), "doc", "sequence")
    assert rows(allot(20, 0), "doc", "sequence") == first
    second = [tuple(r) for r in allot(50, 1).select("doc", "r", "sequence", "control_number").collect()]
    assert sorted(second, key=str) == sorted((tuple(r) for r in allot(50, 1).select("doc", "r", "sequence", "control_number").collect()), key=str)
    assert len(second) == 50 and sorted((d, n) for d, _, n, _ in second if d < 20) == sorted(first)
    for receiver in ("R1", None):
        own = sorted(n for _, r, n, _ in second if r == receiver)
        assert own == list(range(1, len(own) + 1))
    assert all(text == f"{n:09d}" for _, _, n, text in second)
    assert allot(0, 2).count() == 0


# ------------------------------------------------------------ order trigger

CHANGES = "order_id bigint, commit_ts timestamp_ntz, replay_id bigint, status string"
STATUSES = T.StructType().add("order_id", T.LongType()).add("status", T.StringType())
SUBMITTED = "Submitted to Manufacturing"


def edges(events):
    last, found = {}, []
    for order, at, replay, status in events:
        if status == SUBMITTED and last.get(order, "none so far") != SUBMITTED:
            found.append((order, at, replay, status))
        last[order] = status
    return sorted(found, key=str)


@pytest.mark.parametrize("size", [1, 3, 100])
def test_submitted_once_whatever_the_batches(spark, tmp_path, size):
    day, names = dt.datetime(2024, 1, 1), ["Draft", SUBMITTED, SUBMITTED, None, SUBMITTED, "Revision Required", SUBMITTED]
    events = [(i % 3, day + dt.timedelta(minutes=i), i, names[i % 7]) for i in range(12)]
    log = ReplicaLog(spark, str(tmp_path / "s"), ["order_id"], STATUSES, partial=False, buckets=2)
    path, check = str(tmp_path / "out"), str(tmp_path / "c")
    landed = str(tmp_path / "in")
    for start in range(0, len(events), size):
        spark.createDataFrame(events[start : start + size], CHANGES).coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(landed)
    entered, late = order_trigger.run_trigger(stream, log, path, check, "order_id", compact_every=2)
    assert sorted((tuple(r) for r in entered.collect()), key=str) == edges(events)
    assert late.count() == 0


def test_late_changes_trigger_nothing_and_are_kept(spark):
    day = dt.datetime(2024, 1, 1)
    before = spark.createDataFrame([(1, day, 5, "Draft"), (2, day, 5, SUBMITTED)], CHANGES)
    batch = spark.createDataFrame([(1, day, 4, SUBMITTED), (1, day, 6, SUBMITTED), (2, day, 6, SUBMITTED), (3, day, 1, SUBMITTED), (3, day, 2, None)], CHANGES)
    got = order_trigger.entered_status(batch, before, "order_id", "status")
    assert rows(got, "order_id", "replay_id", "is_late", "entered") == [(1, 4, True, False), (1, 6, False, True), (2, 6, False, False), (3, 1, False, True), (3, 2, False, False)]


# ------------------------------------------------------------ refused documents


def test_every_document_gives_rows_or_a_reason(spark):
    texts = ["<I><Id>a</Id></I>", "<I><Id>a</I>", "", None, "text"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, x string")
    parsed = xml_docs.parse_documents(df, "x", "I", "struct<Id:string>", keep=["n"])
    assert rows(parsed.filter("reason is null").select("n", "doc.Id")) == [(0, "a")]
    assert [r[0] for r in rows(xml_docs.unreadable_documents(parsed, ["n"]))] == [1, 2, 3, 4]
    bodies = spark.createDataFrame([(0, '{"a":[{"k":"x"}]}'), (1, '{"a":'), (2, "[1]"), (3, None), (4, "null"), (5, "{}")], "n int, b string")
    assert [r[0] for r in rows(json_docs.unreadable_documents(bodies, "b", ["n"]))] == [1, 2, 3, 4]


# ------------------------------------------------------------ as-of join, positions, ends of state


@pytest.mark.parametrize("partitions", [1, 7])
def test_as_of_join_is_the_plain_one(spark, partitions):
    import random

    from tideline.operators.asof import as_of_join

    chance = random.Random(4)
    day = dt.datetime(2024, 1, 1)
    at = lambda: chance.choice([None, *[day + dt.timedelta(hours=h) for h in range(40)]])
    topics = ["hot"] * 8 + ["a", "b", "never", None]
    events = [(i, chance.choice(topics), at()) for i in range(400)]
    rows_ = [(chance.choice(["hot", "hot", "a", "b", "c", None]), at(), chance.randint(0, 9)) for _ in range(60)]
    want = []
    for i, t, e in events:
        known = [(r, v) for k, r, v in rows_ if k == t is not None and r is not None and e is not None and r <= e]
        want.append((i, t, e, *(max(known) if known else (None, None))))
    got = as_of_join(
        spark.createDataFrame(events, "i int, topic string, commit_ts timestamp_ntz"), spark.createDataFrame(rows_, "topic string, since timestamp_ntz, v int"),
        ["topic"], "commit_ts", "since", ["v"], partitions,
    )
    assert rows(got) == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))


def test_as_of_join_without_rows_or_events(spark):
    from tideline.operators.asof import as_of_join

    events = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1))], "i int, topic string, commit_ts timestamp_ntz")
    none = spark.createDataFrame([], "topic string, since timestamp_ntz, v int")
    assert rows(as_of_join(events, none, ["topic"], "commit_ts", "since", ["v"]), "i", "v") == [(1, None)]
    assert as_of_join(events.limit(0), none, ["topic"], "commit_ts", "since", ["v"]).count() == 0


def test_positions_merge_whatever_the_batches(spark, tmp_path):
    import random

    from tideline.streaming.positions import ReplayPositions

    chance = random.Random(9)
    ids = [("t", i) for i in [*range(0, 50), *range(60, 70), 65_535, 65_536, 65_537, -3]] + [("u", 5), ("u", 5), (None, 1), ("u", None)]
    chance.shuffle(ids)
    held = ReplayPositions(spark, str(tmp_path / "p"))
    for batch in range(4):
        frame = spark.createDataFrame(ids[batch::4], "topic string, replay_id bigint")
        held.advance(frame, batch)
        held.advance(frame, batch)  # runs again
    assert rows(held.ranges()) == [("t", -3, -3), ("t", 0, 49), ("t", 60, 69), ("t", 65535, 65537), ("u", 5, 5)]
    assert rows(held.gaps()) == [("t", -2, -1), ("t", 50, 59), ("t", 70, 65534)]
    assert len(list((tmp_path / "p").iterdir())) == 2


def test_state_is_bounded_by_live_records_and_the_window(spark, tmp_path):
    from .test_streaming import CHANGES as EVENTS
    from .test_streaming import STATE

    log = ReplicaLog(spark, str(tmp_path / "r"), ["record_id"], STATE, buckets=1)
    day = dt.datetime(2024, 1, 1)
    for batch in range(6):  # ten records come and go each day, one stays
        at = day + dt.timedelta(days=batch)
        come = [(f"d{batch}-{i}", at, 20 * batch + i, "CREATE", [], 1.0, 1) for i in range(10)] + [(f"keep{batch}", at, 1000 + batch, "CREATE", [], 2.0, 2)]
        go = [(f"d{batch}-{i}", at + dt.timedelta(hours=1), 500 + 20 * batch + i, "DELETE", [], None, None) for i in range(10)]
        stray = [(f"never{batch}", at, 2000 + batch, "UPDATE", ["Value__c"], 3.0, None)]
        log.append(spark.createDataFrame(come + go + stray, EVENTS), batch)
        log.compact(low_water=at - dt.timedelta(days=1))
    assert rows(log.current(), "record_id") == [(f"keep{b}",) for b in range(6)]
    assert log.folded().count() == 6 + 2 * 11  # live ones; deletes and strays of the last two days


def test_roles_by_a_shared_table_are_those_by_one_join_each(spark):
    """Receivers that many partnerships share: missing, NULL and unknown ones, and a key that occurs twice."""
    accounts = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    lines = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "x"), (4, "a"), (None, "b")], "k int, sender string")
    deals = spark.createDataFrame([(1, "b"), (2, "y"), (3, None), (3, "a")], "k int, receiver string")
    columns = ("k", "sender", "receiver", "sender_name", "receiver_name")
    once = registry.with_roles(lines.join(deals, "k", "left"), accounts, "sender", "receiver", "id", ["name"])
    shared = registry.with_roles(lines, accounts, "sender", "receiver", "id", ["name"], deals, "k")
    assert rows(shared, *columns) == rows(once, *columns)
    assert len(rows(shared)) == 7
