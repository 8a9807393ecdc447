"""Messages that wait for an answer, and documents written by many tasks."""

from __future__ import annotations

import glob
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tideline.operators import export, outbox

from .conftest import rows


def _messages(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    return df.withColumn("message_key", outbox.message_key(F.col("name")))


def _answers(sent, failing):
    """Answers to what was sent: refused where the name is in ``failing``."""
    ok = ~F.col("name").isin(*failing) if failing else F.lit(True)
    return sent.select("message_key", "attempt", ok.alias("ok"), F.when(~ok, F.lit("no")).alias("error"))


def test_only_failures_go_again_and_a_rerun_sends_the_same(spark, tmp_path):
    ledger = str(tmp_path / "sent")
    messages = _messages(spark, ["a", "b", "c", "c"])
    none = spark.createDataFrame([], outbox.RESULTS)
    first = outbox.send_due(messages, ledger, none, 1)
    assert rows(first, "name", "attempt") == [("a", 1), ("b", 1), ("c", 1)]
    answers = _answers(first.filter("name <> 'c'"), ["b"])  # c gets no answer
    more = _messages(spark, ["a", "b", "c", "d"])
    for _ in range(2):
        assert rows(outbox.send_due(more, ledger, answers, 2), "name", "attempt") == [("b", 2), ("d", 1)]
    assert rows(outbox.send_due(more, ledger, answers, 3)) == []  # the second answers are still to come
    assert rows(outbox.outbox_report(_messages(spark, "abcde"), ledger, answers, ["name"])) == [
        ("a", 1, "acknowledged", None), ("b", 2, "sent", None), ("c", 1, "sent", None), ("d", 1, "sent", None), ("e", 0, "new", None),
    ]


def test_late_success_and_repeated_answers(spark, tmp_path):
    ledger = str(tmp_path / "sent")
    messages = _messages(spark, ["a", "b", "z"])
    outbox.send_due(messages, ledger, spark.createDataFrame([], outbox.RESULTS), 1)
    key = {r["name"]: r["message_key"] for r in messages.collect()}
    answers = [(key["a"], 1, False, "busy"), (key["a"], 1, True, None), (key["a"], 1, False, "busy"), (key["b"], 1, None, None), ("never sent", 1, False, "x")]
    results = spark.createDataFrame(answers, outbox.RESULTS)
    report = outbox.outbox_report(messages, ledger, results, ["name"])
    assert rows(report) == [("a", 1, "acknowledged", None), ("b", 1, "failed", None), ("z", 1, "sent", None)]
    assert rows(outbox.send_due(messages, ledger, results, 2, max_attempts=1)) == []
    assert rows(outbox.send_due(messages, ledger, results, 2), "name", "attempt") == [("b", 2)]


def test_keys_tell_nulls_and_borders_apart(spark):
    pairs = [("a", "b"), ("ab", ""), ("ab", None), (None, "ab"), ("", "ab")]
    df = spark.createDataFrame(pairs, "x string, y string")
    assert df.select(outbox.message_key(F.col("x"), F.col("y"))).distinct().count() == 5


def _whole(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))


@pytest.mark.parametrize("n, partitions", [(0, 4), (1, 4), (3, 211), (5000, 211)])
def test_parts_together_are_one_document(spark, tmp_path, n, partitions):
    df = spark.range(n).select(((F.col("id") * 7919) % 5003).alias("k"), F.concat(F.lit("<&\"é"), F.col("id").cast("string")).alias("s"))
    export.write_json_array(df, [F.col("k")], str(tmp_path / "json"), partitions=partitions)
    export.write_xml_document(df, [F.col("k")], str(tmp_path / "xml"), "Row", partitions=partitions)
    want = [(r["k"], r["s"]) for r in df.orderBy("k").collect()]
    assert [(r["k"], r["s"]) for r in json.loads(_whole(tmp_path / "json"))] == want
    root = ET.fromstring(_whole(tmp_path / "xml"))
    assert root.tag == "X" and [(int(r.find("k").text), r.find("s").text) for r in root] == want
    if n == 5000:
        assert len(glob.glob(str(tmp_path / "json" / "part-*"))) > 100


def test_what_goes_out_is_read_from_the_ledger_without_another_shuffle(spark, tmp_path):
    messages = _messages(spark, ["a", "b", "b"])
    sent = outbox.send_due(messages, str(tmp_path / "sent"), spark.createDataFrame([], outbox.RESULTS), 1)
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and sent.columns == ["name", "message_key", "attempt"]
    assert rows(sent, "name", "attempt") == [("a", 1), ("b", 1)]


def test_packed_keys_come_back(spark):
    keys = ["ab" * 32, "AB" * 32, "a", "", "é", None, "0" * 63]
    df = spark.createDataFrame([(k,) for k in keys], "message_key string")
    packed = df.select("message_key", outbox._packed(F.col("message_key")).alias("p"))
    assert all(r[0] == r[1] for r in packed.select("message_key", outbox._unpacked(F.col("p")).alias("q")).collect())
    assert packed.select("p").distinct().count() == len(keys)
