from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.apply import fold_changes, latest_state
from tideline.operators.delta import fan_out, split_dead_letters
from tideline.plans import domain
from tideline.sources import feed
from tideline.streaming import apply as streams
from tideline.streaming.replica import ReplicaLog

from .conftest import rows

STATE = T.StructType().add("record_id", T.StringType()).add("Value__c", T.DoubleType()).add("K__c", T.IntegerType())


@pytest.fixture(scope="module")
def landed(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed") / "landed")
    domain.envelopes(spark, sf_dir).repartition(6).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def batch_result(spark, sf_dir):
    good, _ = split_dead_letters(feed.decode_events(feed.split_envelopes(domain.envelopes(spark, sf_dir)), domain.PAYLOAD))
    return rows(latest_state(fan_out(good), ["record_id"], ["Value__c", "K__c"]), "record_id", "Value__c", "K__c")


def decoded(spark, path, max_files):
    return feed.decode_events(feed.split_envelopes(feed.read_envelopes(spark, path, max_files)), domain.PAYLOAD)


@pytest.mark.parametrize("max_files", [1, 4, None])
def test_stream_equals_batch(spark, landed, batch_result, tmp_path, max_files):
    log = ReplicaLog(spark, str(tmp_path / "r"), ["record_id"], STATE, partial=False)
    streams.apply_feed(decoded(spark, landed, max_files), log, str(tmp_path / "dead"), str(tmp_path / "c"), compact_every=2)
    assert rows(log.current()) == batch_result


def test_restart_resumes_and_repeats_are_harmless(spark, sf_dir, batch_result, tmp_path):
    path, log = str(tmp_path / "in"), ReplicaLog(spark, str(tmp_path / "r"), ["record_id"], STATE, partial=False)
    envelopes = domain.envelopes(spark, sf_dir)
    args = (log, str(tmp_path / "dead"), str(tmp_path / "c"))
    envelopes.filter("latest_replay_id >= 500").coalesce(2).write.parquet(path)  # the later half lands first
    streams.apply_feed(decoded(spark, path, 1), *args)
    log.compact()
    envelopes.filter("latest_replay_id < 500").coalesce(2).write.mode("append").parquet(path)
    streams.apply_feed(decoded(spark, path, 1), *args)
    assert rows(log.current()) == batch_result
    streams.apply_feed(decoded(spark, path, 1), *args)  # nothing new: no batch
    assert rows(log.current()) == batch_result
    log.compact()
    log.compact()
    assert rows(log.current()) == batch_result


def test_empty_batch_is_a_keepalive(spark, tmp_path):
    log = ReplicaLog(spark, str(tmp_path / "r"), ["record_id"], STATE, partial=False)
    assert rows(log.current()) == []
    path = str(tmp_path / "in")
    spark.createDataFrame([("t", None, [])], feed.ENVELOPE_DDL).write.parquet(path)
    streams.apply_feed(decoded(spark, path, None), log, str(tmp_path / "dead"), str(tmp_path / "c"))
    assert rows(log.current()) == []


def test_late_change_does_not_revive(spark, tmp_path):
    log = ReplicaLog(spark, str(tmp_path / "r"), ["record_id"], STATE, partial=False)
    ddl = "record_id string, commit_ts timestamp_ntz, replay_id bigint, change_type string, Value__c double, K__c int"
    day = dt.datetime(2024, 1, 1)

    def batch(*events):
        return spark.createDataFrame([(r, day + dt.timedelta(hours=h), i, kind, v, None) for r, h, i, kind, v in events], ddl)

    log.append(batch(("a", 5, 2, "DELETE", None), ("b", 1, 1, "CREATE", 1.0)), 0)
    log.compact()
    log.append(batch(("a", 3, 1, "UPDATE", 9.0), ("c", 1, 3, "CREATE", 3.0)), 1)
    assert rows(log.current(), "record_id", "Value__c") == [("b", 1.0), ("c", 3.0)]
    log.append(batch(("a", 6, 4, "CREATE", 4.0)), 2)
    log.append(batch(("a", 6, 4, "CREATE", 4.0)), 2)  # the same batch again
    assert rows(log.current(), "record_id", "Value__c") == [("a", 4.0), ("b", 1.0), ("c", 3.0)]
    log.compact()
    assert rows(log.current(), "record_id", "Value__c") == [("a", 4.0), ("b", 1.0), ("c", 3.0)]


@pytest.mark.parametrize("max_files", [1, None])
def test_partial_updates_fold_by_field(spark, landed, tmp_path, max_files):
    log = ReplicaLog(spark, str(tmp_path / "r"), ["record_id"], STATE)
    streams.apply_feed(decoded(spark, landed, max_files), log, str(tmp_path / "dead"), str(tmp_path / "c"), compact_every=3)
    good, _ = split_dead_letters(feed.decode_events(feed.split_envelopes(spark.read.parquet(landed)), domain.PAYLOAD))
    assert rows(log.current()) == rows(fold_changes(fan_out(good), ["record_id"], ["Value__c", "K__c"]), "record_id", "Value__c", "K__c")


def test_update_before_its_create_counts_once_both_are_there(spark, tmp_path):
    ddl = "record_id string, commit_ts timestamp_ntz, replay_id bigint, change_type string, changed_fields array<string>, Value__c double, K__c int"
    day = dt.datetime(2024, 1, 1)
    create = ("a", day, 1, "CREATE", [], 1.0, 1)
    update = ("a", day + dt.timedelta(hours=1), 2, "UPDATE", ["Value__c"], None, None)
    log = ReplicaLog(spark, str(tmp_path / "r"), ["record_id"], STATE)
    log.append(spark.createDataFrame([update], ddl), 0)
    assert rows(log.current()) == []
    log.compact()
    log.append(spark.createDataFrame([create], ddl), 1)
    assert rows(log.current()) == [("a", None, 1)]


def test_dead_letters_are_whole(spark, landed, tmp_path):
    log = ReplicaLog(spark, str(tmp_path / "r"), ["record_id"], STATE, partial=False)
    streams.apply_feed(decoded(spark, landed, 2), log, str(tmp_path / "dead"), str(tmp_path / "c"))
    batch = feed.decode_events(feed.split_envelopes(spark.read.parquet(landed)), domain.PAYLOAD)
    want = rows(batch.filter(F.col("reason").isNotNull()), "replay_id", "reason")
    assert rows(spark.read.parquet(str(tmp_path / "dead")), "replay_id", "reason") == want


def test_torn_compaction_loses_nothing(spark, tmp_path):
    """A base without its manifest entry, the state a crash in the middle leaves, does not count."""
    import os

    log = ReplicaLog(spark, str(tmp_path / "r"), ["record_id"], STATE)
    ddl = "record_id string, commit_ts timestamp_ntz, replay_id bigint, change_type string, changed_fields array<string>, Value__c double, K__c int"
    events = [(f"r{i}", dt.datetime(2024, 1, 1), i, "CREATE", [], float(i), i) for i in range(1000)]
    log.append(spark.createDataFrame(events, ddl), 0)
    whole = log.folded().repartition(4)
    whole.limit(250).write.parquet(f"{log.path}/base/version=0")
    assert log.current().count() == 1000
    log.append(spark.createDataFrame(events, ddl), 0)
    log.compact()
    assert log.current().count() == 1000 and os.path.exists(f"{log.path}/manifest")


CHANGES = "record_id string, commit_ts timestamp_ntz, replay_id bigint, change_type string, changed_fields array<string>, Value__c double, K__c int"


def files_below(path):
    import os

    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_many_batches_leave_a_bounded_number_of_files(spark, tmp_path):
    log = ReplicaLog(spark, str(tmp_path / "r"), ["record_id"], STATE, buckets=2)
    day = dt.datetime(2024, 1, 1)
    seen = []
    for batch in range(45):
        kind, fields = ("CREATE", []) if batch < 10 else ("UPDATE", ["Value__c"])
        event = (f"r{batch % 10}", day + dt.timedelta(minutes=batch), batch, kind, fields, float(batch), batch)
        log.append(spark.createDataFrame([event], CHANGES).coalesce(1), batch)
        if batch % 5 == 4:
            log.compact()
            seen.append(len(files_below(log.path)))
    assert max(seen) <= 2 * 5 + 2 * 2 * 2 + 2 and seen[-1] <= seen[3] + 2  # two generations of batches, buckets and manifests
    assert rows(log.current()) == sorted((f"r{i}", float(40 + i if i < 5 else 30 + i), i) for i in range(10))


def test_one_changed_record_rewrites_one_bucket(spark, tmp_path):
    log = ReplicaLog(spark, str(tmp_path / "r"), ["record_id"], STATE, buckets=8)
    image = spark.createDataFrame([(f"r{i}", float(i), i) for i in range(200)], "record_id string, Value__c double, K__c int")
    log.bootstrap(image)
    before = files_below(f"{log.path}/base")
    assert len(before) == 8 and log.current().count() == 200
    log.append(spark.createDataFrame([("r7", dt.datetime(2024, 1, 1), 1, "UPDATE", ["Value__c"], 0.5, None)], CHANGES), 0)
    log.compact()
    new = [f for f in files_below(f"{log.path}/base") if f not in before]
    assert len(new) == 1 and new[0].startswith("version=0/bucket=")
    assert rows(log.current().filter("record_id in ('r7', 'r8')")) == [("r7", 0.5, 7), ("r8", 8.0, 8)]


def test_bootstrap_holds_records_from_before_the_feed(spark, tmp_path):
    log = ReplicaLog(spark, str(tmp_path / "r"), ["record_id"], STATE, buckets=2)
    as_of = dt.datetime(2024, 1, 2)
    late, early = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 1)
    events = [
        ("a", late, 1, "UPDATE", ["Value__c"], 9.0, None),  # of an older record
        ("b", late, 2, "DELETE", [], None, None),
        ("c", early, 3, "UPDATE", ["Value__c"], 7.0, None),  # the snapshot holds it already
        ("d", early, 4, "DELETE", [], None, None),  # before it was created again
        ("e", late, 5, "CREATE", [], 5.0, 5),
    ]
    log.append(spark.createDataFrame(events, CHANGES), 0)  # the feed may have begun
    (tmp_path / "r" / "base" / "version=-1" / "bucket=0").mkdir(parents=True)  # a bootstrap that broke off
    log.bootstrap(spark.createDataFrame([(k, 1.0, 1) for k in "abcd"], "record_id string, Value__c double, K__c int"), as_of)
    want = [("a", 9.0, 1), ("c", 1.0, 1), ("d", 1.0, 1), ("e", 5.0, 5)]
    assert rows(log.current()) == want
    log.compact()
    assert rows(log.current()) == want
    with pytest.raises(ValueError, match="has a base"):
        log.bootstrap(spark.createDataFrame([], STATE))


def test_a_reader_of_the_manifest_before_can_finish(spark, tmp_path):
    log = ReplicaLog(spark, str(tmp_path / "r"), ["record_id"], STATE, buckets=2)
    event = lambda i: spark.createDataFrame([("a", dt.datetime(2024, 1, 1), i, "CREATE", [], float(i), i)], CHANGES)
    log.append(event(1), 0)
    log.compact()
    begun = log.current()
    log.append(event(2), 1)
    log.compact()
    assert rows(begun) == [("a", 1.0, 1)] and rows(log.current()) == [("a", 2.0, 2)]


def test_a_manifest_that_was_not_committed_does_not_count(spark, tmp_path):
    log = ReplicaLog(spark, str(tmp_path / "r"), ["record_id"], STATE, buckets=2)
    log.bootstrap(spark.createDataFrame([("a", 1.0, 1)], STATE))
    (tmp_path / "r" / "manifest" / "at=5").mkdir()
    assert rows(log.current()) == [("a", 1.0, 1)]


def test_events_without_changed_fields_need_whole_images(spark, tmp_path):
    log = ReplicaLog(spark, str(tmp_path / "r"), ["record_id"], STATE)
    with pytest.raises(ValueError, match="partial=False"):
        log.append(spark.createDataFrame([], CHANGES).drop("changed_fields"), 0)


def test_every_webhook_body_is_applied_or_refused(spark):
    from tideline.sources import snapshot

    schema = "change_type string, as2_id string, commit_ts timestamp_ntz, replay_id bigint"
    bodies = ['{"change_type":"update","as2_id":"P1","commit_ts":"2024-01-01 00:00:00","replay_id":1}', "{", "", "[]", "7", "null", None,
              '{"as2_id":"P2"}', '{"change_type":"update","as2_id":"P1","replay_id":"x"}', '{"change_type":"delete","as2_id":"P1"}']
    got = snapshot.parse_bodies(spark.createDataFrame([(b,) for b in bodies], "value string"), schema, ["as2_id"])
    reasons = {r["body"]: r["reason"] for r in got.collect()}
    assert len(reasons) == len(bodies) == got.count()
    assert reasons[bodies[0]] is None and reasons["{"] == reasons[bodies[8]] == reasons[None] == "body_unreadable"
    assert reasons['{"as2_id":"P2"}'] == "unknown_change_type" and reasons[bodies[9]] == "no_commit_time_or_replay_id"
    assert all(reasons[b] for b in bodies[1:])
