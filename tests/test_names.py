from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tideline.functions import names, text

from .conftest import column


def value():
    return F.col("v")


def test_object_to_event(spark):
    given = ["Account", "Order__c", "Order__C", "__c", "X__c__c", "", "  ", None]
    assert column(spark, given, names.object_to_event(value())) == [
        "AccountChangeEvent", "Order__ChangeEvent", "Order__ChangeEvent", "__c__ChangeEvent", "X__c__ChangeEvent", None, None, None,
    ]


def test_strict_raises_on_blank(spark):
    with pytest.raises(Exception, match="blank object name"):
        column(spark, [""], names.object_to_event(value(), strict=True))
    with pytest.raises(Exception, match="not a change event name"):
        column(spark, ["Account"], names.event_to_object_strict(value(), strict=True))


def test_event_to_object(spark):
    given = ["AccountChangeEvent", "Order__ChangeEvent", "Account", "accountchangeevent", "/data/Order__ChangeEvent", "ChangeEvent", "", None]
    assert column(spark, given, names.event_to_object(value())) == ["Account", "Order__c", "Account", "accountchangeevent", "Order__c", "", None, None]


def test_event_to_object_strict(spark):
    given = ["AccountChangeEvent", "order__changeevent", "Account", "ChangeEvent", ""]
    assert column(spark, given, names.event_to_object_strict(value())) == ["Account", "order__c", None, None, None]


def test_channel_member(spark):
    given = ["Account", "Order__c", "Order__C", " ", None]
    assert column(spark, given, names.channel_member(value())) == [
        "ChangeEvents_AccountChangeEvent", "ChangeEvents_Order_ChangeEvent", "ChangeEvents_Order__C_ChangeEvent", None, None,
    ]


def test_topic_path_falls_back(spark):
    assert column(spark, ["A__c", "", None], names.topic_path(value(), F.lit("Other"))) == ["/data/A__ChangeEvent", "/data/OtherChangeEvent", "/data/OtherChangeEvent"]


def test_object_of_query(spark):
    given = ["select Id from Account where x", "SELECT a FROM\n Order__c", "from été", "no", "", "select fromage, x from B"]
    assert column(spark, given, names.object_of_query(value())) == ["Account", "Order__c", None, None, None, "B"]


def test_change_type(spark):
    given = ["entity: A, value: CREATE, value: DELETE", "value:UPDATE", "nothing", None]
    assert column(spark, given, text.change_type_of(value())) == ["CREATE", "UPDATE", "Unknown", "Unknown"]


def test_type_tag(spark):
    assert column(spark, ["Data:Text:DateTime", "plain", "x:", None], text.type_tag(value())) == ["DateTime", "plain", "", "Unknown"]


def test_error_message(spark):
    given = [
        '[{"message":"m","errorCode":"c","fields":["a","b"]},{"errorCode":"d"}]',
        "oops",
        "[]",
        '{"message":"m"}',
        "[broken",
    ]
    assert column(spark, given, text.error_message(value())) == [
        "Error: m (Code: c, Fields: a, b); Error: Unknown error (Code: d, Fields: )",
        "oops",
        "",
        '{"message":"m"}',
        "[broken",
    ]


def test_html_encode(spark):
    assert column(spark, ["<a href=\"x\">&'</a>"], text.html_encode(value())) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;&lt;/a&gt;"]
