"""Payloads read by the schema their event names, and changed fields as bitmaps."""

from __future__ import annotations

import base64
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.sources import schemas
from tideline.sources.schemas import WantedField

from .conftest import rows

HEADER = {"entityName": "Account", "changeType": "UPDATE", "recordIds": ["r1"]}


def registry(spark, **texts):
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps({"type": "record", "fields": v})) for k, v in texts.items()], "schema_id string, schema_json string")


def events(spark, *given_):
    coded = [(i, s, None if p is None else base64.b64encode(p if isinstance(p, bytes) else json.dumps(p).encode()).decode()) for i, (s, p) in enumerate(given_)]
    return spark.createDataFrame(coded, "replay_id int, schema_id string, payload string").withColumn("reason", F.lit(None).cast("string"))


def payload(changed=("A",), **values):
    return {"ChangeEventHeader": {**HEADER, "changedFields": list(changed)}, "commit_ts": "2024-01-01T00:00:00", **values}


def field(name, kind):
    return {"name": name, "type": kind}


WANTED = [WantedField("A", "double", aliases=("Old_A",)), WantedField("B", "string", default="none")]


def decoded(spark, reg, *given_, wanted=WANTED):
    out = schemas.decode_by_schema(events(spark, *given_), reg, wanted)
    return [tuple(r) for r in out.select("reason", "A", "B", F.array_join("changed_fields", ",")).orderBy("replay_id").collect()]


def test_each_event_is_read_by_its_own_schema(spark):
    reg = registry(
        spark,
        one=[field("A", "int"), field("B", "string")],
        two=[field("C", "string"), field("Old_A", ["null", "double"])],
        odd=[field("A", {"type": "long", "logicalType": "timestamp-millis"}), field("B", ["null", {"type": "enum", "name": "E", "symbols": []}])],
    )
    got = decoded(spark, reg, ("one", payload(A=3, B="x")), ("two", payload(["Old_A", "C"], Old_A=0.5, C="y")), ("odd", payload(["B"], A=7, B="s")), ("two", payload(["Old_A"], Old_A=None)))
    assert got == [(None, 3.0, "x", "A"), (None, 0.5, "none", "A"), (None, 7.0, "s", "B"), (None, None, "none", "A")]


def test_what_cannot_be_resolved_is_refused_with_its_reason(spark):
    reg = registry(spark, text=[field("A", "string")], without=[field("B", "string")], broken="{", scalar="7")
    got = decoded(spark, reg, ("text", payload(A="3")), ("without", payload(B="x")), ("broken", payload(A=1)), ("scalar", payload(A=1)), ("new", payload(A=1)), (None, payload(A=1)))
    assert [g[0] for g in got] == ["type_not_promotable:A", "field_missing:A", "schema_unreadable", "schema_unreadable", "schema_unknown", "schema_unknown"]
    assert all(g[1] is None and g[2] is None for g in got)


@pytest.mark.parametrize("body", [b"no json", b"7", b"[1]", b"", None])
def test_unreadable_payloads_are_refused(spark, body):
    assert decoded(spark, registry(spark, one=[field("A", "int")]), ("one", body))[0][0] == "decode_failed"


def test_a_schema_registered_twice_counts_once(spark):
    reg = registry(spark, one=[field("A", "int")])
    other = registry(spark, one="no schema")
    got = decoded(spark, reg.unionByName(reg).unionByName(other), ("one", payload(A=1)))
    assert got == [(None, 1.0, "none", "A")]


NAMES = [f"F{i}" for i in range(70)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sets(st.integers(0, 69)), min_size=1, max_size=8))
def test_bitmaps_name_the_fields_whose_bits_are_set(spark, chosen):
    bitmaps = [(i, [f"0x{sum(1 << b for b in bits):X}"]) for i, bits in enumerate(chosen)]
    df = spark.createDataFrame(bitmaps, "i int, c array<string>")
    named = schemas.changed_names(F.col("c"), F.array(*[F.lit(n) for n in NAMES]), F.array(*[F.array().cast("array<string>")] * 70))
    got = {r["i"]: r["n"] for r in df.select("i", named.alias("n")).collect()}
    assert got == {i: [NAMES[b] for b in sorted(bits)] for i, bits in enumerate(chosen)}


def test_parts_of_compound_fields(spark):
    reg = registry(spark, s=[field("Id", "string"), field("Name", ["null", {"type": "record", "name": "N", "fields": [field("First", "string"), field("Last", "string")]}]), field("Tel", "string")])
    resolved = schemas.resolve(reg, [WantedField("Id", "string")])
    df = resolved.crossJoin(spark.createDataFrame([(["1-0x02"],), (["0x5", "1-0x3"],), (["Tel", "0x1"],), (["9-0x1"],), ([],)], "c array<string>"))
    got = rows(df.select(F.array_join("c", ";"), F.array_join(schemas.changed_names(F.col("c"), F.col("names"), F.col("parts")), ";")))
    assert got == [("", ""), ("0x5;1-0x3", "Id;Tel;Name;Name.First;Name.Last"), ("1-0x02", "Name;Name.Last"), ("9-0x1", "9-0x1"), ("Tel;0x1", "Tel;Id")]
