"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tideline.plans import checks as library_checks
from tideline.plans import queries as library_queries

from .compare import connect, differences

QUERIES = entry.queries()
CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert differences(con, QUERIES[name](spark, sf_dir), CHECKS[name]) is None


def test_every_query_of_the_library_has_a_check():
    """Optional subpackages may register queries that SQL cannot express; their own tests cover those."""
    assert set(CHECKS) <= set(QUERIES)
    assert set(library_queries()) == set(library_checks())


def test_entry_runs(spark):
    result = entry.entry(spark)
    assert result.columns == ["record_id", "commit_ts", "replay_id", "Value__c", "K__c"]
    assert result.count() > 0
