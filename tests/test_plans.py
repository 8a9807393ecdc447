"""The plans that matter at scale: pruned scans, pushed filters, few exchanges."""

from __future__ import annotations

import re

import pytest

from tideline.plans import queries

QUERIES = queries()


@pytest.fixture
def plan(spark, sf_dir):
    """Plan text of a query with size-based broadcasts off, as for tables too large for them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)

    def explain(name):
        return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()

    yield explain
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(text):
    return len(re.findall(r"Exchange (hash|range|Single)", text))


def scanned(text):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


@pytest.mark.parametrize(
    ("name", "most"),
    [
        ("cdc_latest_state", 1), ("cdc_fold_changes", 1), ("cdc_partial_update", 1), ("cdc_transpose", 1), ("edi_status_update", 1),
        ("cdc_delta_long", 0), ("cdc_id_row", 0), ("payload_decode", 0), ("typed_cast", 0), ("edi_validate", 0), ("row_to_pairs", 0),
        ("order_transitions", 1), ("cdc_delete", 2), ("outbound_changes", 2), ("order_document", 6), ("keyed_upsert", 1), ("cdc_field_filter", 0),
    ],
)
def test_exchanges(plan, name, most):
    assert exchanges(plan(name)) <= most


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("count_by_key", {"user_id", "event_type"}),
        ("check_length", {"doc_id", "text"}),
        ("distinct_keys", {"o_custkey"}),
        ("check_primary_key", {"l_orderkey", "l_linenumber"}),
        ("order_list", {"o_orderkey", "o_orderstatus"}),
        ("dedupe", {"user_id", "event_type"}),
    ],
)
def test_scans_are_pruned(plan, name, columns):
    assert scanned(plan(name)) == [columns]


def test_filters_reach_the_scan(plan):
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan("result_counts")
    assert "TakeOrderedAndProject" in plan("first_record")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream") and n not in ("change_feed", "webhook_feed")))
def test_no_pairwise_join_and_no_python(plan, name):
    text = plan(name)
    for refused in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert refused not in text
