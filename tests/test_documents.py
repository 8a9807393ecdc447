from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tideline.operators import edi, export, orders, schema, shape
from tideline.plans import domain
from tideline.sources import json_docs, snapshot, xml_docs

from .conftest import column, rows


def test_json_records_follow_the_first_record(spark):
    pages = [
        (1, '{"records":[]}'),
        (2, '{"records":[{"attributes":{"type":"A"},"Id":"1","N":1,"B":true,"X":null,"O":{"a":1}},{"Id":"2","N":null,"Late":"x","O":[1,2]}]}'),
        (3, '{"records":[{"Id":"3","N":2.5,"B":false,"X":"set","O":null}]}'),
        (4, "{}"),
    ]
    df = spark.createDataFrame(pages, "page int, body string")
    found = json_docs.schema_of_first_record(df, "body", [F.col("page")])
    assert found.simpleString() == "struct<Id:string,N:double,B:boolean,X:string,O:string>"
    assert rows(json_docs.json_records(df, "body", found)) == [
        ("1", 1.0, True, None, '{"a":1}'),
        ("2", None, None, None, "[1,2]"),
        ("3", 2.5, False, "set", None),
    ]


def test_flatten_single_object_as_list(spark):
    df = spark.createDataFrame([(1, '{"a":[{"k":"x"},{"k":"y"}]}'), (2, '{"a":{"k":"z"}}'), (3, "broken")], "id int, body string")
    assert rows(json_docs.flatten_document(df, "body", "a", "struct<k:string>", ["id"])) == [(1, 0, "x"), (1, 1, "y"), (2, 0, "z")]


def test_rows_to_json_drops_and_keeps(spark):
    df = spark.createDataFrame([(1, None, "x", None, dt.datetime(2024, 1, 1)), (2, 5, None, None, None)], "id int, n int, s string, e string, t timestamp_ntz")
    assert [r[0] for r in export.rows_to_json(df, excluded=" ID ").orderBy("json").collect()] == [
        '{"n":5,"s":null,"t":null}',
        '{"n":null,"s":"x","t":"2024-01-01T00:00:00"}',
    ]
    assert [list(json.loads(r[0])) for r in export.row_to_json(df, excluded="ID,n").collect()] == [["id", "s", "e", "t"]] * 2


def test_outbound_changes(spark):
    before = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "Id int, s string, n int")
    after = spark.createDataFrame([(1, "a", 1), (2, None, 2), (9, "new", None)], "Id int, s string, n int")
    assert rows(export.outbound_changes(before, after, "Id")) == [("insert", None, '{"s":"new"}'), ("update", "2", '{"s":null,"n":2}')]
    assert rows(export.outbound_deletes(before, after, "Id", "PlatformEventChannelMember")) == [("3", "PlatformEventChannelMember", "tooling")]


DOCUMENTS = {
    "<Orders><Order><EDI_Seed> 7 </EDI_Seed></Order></Orders>": (None, 7),
    "<?xml version='1.0'?>\n<!-- c --><orders><Order><EDI_Seed>7</EDI_Seed></Order></orders>": (None, 7),
    "<Orders><Order/><Order/></Orders>": (edi.MANY_ROOTS, None),
    "<Orders><Order><EDI_Seed>1</EDI_Seed></Order><Note/></Orders>": (edi.MANY_ROOTS, 1),
    "<Order><A/><B/></Order>": (edi.MANY_ROOTS, None),
    "<Order><A/></Order>": (edi.NOT_ORDERS, None),
    "<Orders/>": (edi.NO_ORDER, None),
    "<Orders><Note>x</Note></Orders>": (edi.NO_ORDER, None),
    "<Orders><Order/></Orders>": (edi.BAD_SEED, None),
    "<Orders><Order><EDI_Seed>x1</EDI_Seed></Order></Orders>": (edi.BAD_SEED, None),
    "<Orders><Order><EDI_Seed>99999999999</EDI_Seed></Order></Orders>": (edi.BAD_SEED, None),
    "<Orders><Order>": (edi.BROKEN, None),
    "<a/><b/>": (edi.BROKEN, None),
    "<Orders><Order><EDI_Seed>1</EDI_Seed></Order></Orders><Orders/>": (edi.BROKEN, 1),
    "<Orders/>tail": (edi.BROKEN, None),
    "no document": (edi.BROKEN, None),
    "": (edi.BROKEN, None),
}


def test_validate_documents(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(DOCUMENTS)], "i int, xml string")
    got = [(r["problem"], r["control_number"]) for r in edi.validate_documents(df, "xml").orderBy("i").collect()]
    assert got == list(DOCUMENTS.values())


def test_set_names(spark):
    assert column(spark, ["850", "856", "810", "997", "855", None], edi.set_name(F.col("v"))) == ["PO", "ASN", "INV", "FA", None, None]


def test_an_order_of_any_size_is_one_document(spark):
    n = 50_000
    headers = spark.createDataFrame([(1, 77), (2, 78)], "order_id int, seed int")
    lines = spark.range(n).select(F.lit(1).alias("order_id"), (n - F.col("id")).alias("line"))
    header, item = [F.col("seed").alias("EDI_Seed")], [F.concat(F.lit("i"), F.col("line")).alias("_Id"), F.lit(2).alias("Quantity")]
    document = orders.order_documents(headers, lines, "order_id", header, [F.col("line")], item)
    assert rows(document.filter("xml like '%EDI_Seed%'"), "order_id", "seq_no") == [(1, 0), (2, 0)]
    found = edi.document_items(document, "xml", ["order_id"])
    same = (F.col("pos") == F.col("seq_no")) & (F.col("item_id") == F.concat(F.lit("i"), F.col("pos")))
    assert found.agg(F.count(F.lit(1)), F.min("pos"), F.max("pos"), F.count_distinct("pos"), F.every(same)).first() == (n, 1, n, n, True)


def test_transitions(spark):
    path = [orders.DRAFT, orders.SUBMITTED, orders.SUBMITTED, orders.REVISION, orders.SUBMITTED, orders.IN_PRODUCTION, orders.COMPLETED, orders.DRAFT]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(path)] + [(2, 0, orders.COMPLETED), (3, 0, None)], "o int, t int, status string")
    for hot in (10**9, 3):
        result = orders.order_transitions(df, "o", ["t"], hot_rows=hot)
        assert [r["allowed"] for r in result.orderBy("o", "t").collect()] == [True] * 7 + [False, False, False]


def test_edge_trigger(spark):
    path = [orders.SUBMITTED, orders.SUBMITTED, orders.REVISION, orders.SUBMITTED]
    df = spark.createDataFrame([("Order__c", 1, i, s) for i, s in enumerate(path)] + [("Account", 1, 9, orders.SUBMITTED)], "table_name string, o int, t int, status string")
    assert rows(orders.submitted_orders(df), "t") == [(0,), (1,), (3,)]
    assert rows(orders.newly_submitted_orders(df, "o", ["t"]), "t") == [(0,), (3,)]


def test_status_documents(spark):
    df = spark.createDataFrame([(1, 1, "855"), (1, 2, "856"), (1, 3, "997"), (2, 1, "810"), (2, 0, "855"), (3, 1, "850")], "o int, t int, doc_type string")
    assert rows(orders.status_after_documents(df, "o", ["t"])) == [(1, orders.IN_PRODUCTION, 2), (2, orders.COMPLETED, None), (3, None, None)]


def test_xml_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a&b", 1), ("c", 2), ("c", 2)], "name string, n int").distinct()
    export.write_xml(df, str(tmp_path / "x"), "Row")
    assert rows(xml_docs.read_xml(spark, str(tmp_path / "x"), "Row", "name string, n int")) == [("a&b", 1), ("c", 2)]


def test_snapshot_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x")], "Id int, Name string, Extra string")
    path = str(tmp_path / "s")
    snapshot.load_snapshot(df, ["ID", "name"], path)
    assert rows(snapshot.load_snapshot(df, ["ID", "name"], path)) == [(1, "a"), (1, "a")]
    with pytest.raises(ValueError, match="no column"):
        schema.match_columns(df, ["zzz"])


def test_picklist_refusals(spark):
    body = json.dumps({"name": "O", "fields": [{"name": "A", "type": "string", "picklistValues": []}, {"name": "P", "type": "picklist", "picklistValues": [{"label": "L", "value": "V", "active": True}]}]})
    df = spark.createDataFrame([(body,)], "body string")
    assert rows(schema.picklist_values(df, "body", "P")) == [("O", "L", "V", True)]
    assert rows(schema.picklist_values(df, "body", "A")) == []
    for field in ("A", "Missing"):
        with pytest.raises(Exception, match="is missing or no picklist"):
            schema.picklist_values(df, "body", field, strict=True).collect()


def test_child_relation_name_must_be_text(spark):
    body = json.dumps({"name": "O", "childRelationships": [{"relationshipName": None, "childSObject": "A"}, {"relationshipName": "Kids", "childSObject": "B", "field": "f", "cascadeDelete": True}, {"childSObject": "C"}]})
    assert rows(schema.child_relations(spark.createDataFrame([(body,)], "body string"), "body")) == [("O", "Kids", "B", "f", True)]


def test_shapes_on_empty_and_null(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert shape.columns_with_values(empty) == []
    assert rows(shape.scalars_or_default(empty, n=(F.max("a"), 7))) == [(7,)]
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert shape.drop_null_columns(df).columns == ["a"]
    assert rows(shape.null_profile(df, ["a", "b"])) == [("a", 2, 0, False, False), ("b", 2, 2, True, True)]
    assert rows(shape.row_to_pairs(df.limit(1), ["a"], ["a", "b"])) == [(1, "a", "1"), (1, "b", None)]
