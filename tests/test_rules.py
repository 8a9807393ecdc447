"""Rules for library code: no driver collects, no row-at-a-time Python, no forced broadcast."""

from __future__ import annotations

import pathlib
import re

import pytest

ROOT = pathlib.Path(__file__).parent.parent / "tideline"
LIBRARY = sorted(p for p in ROOT.rglob("*.py") if "llm" not in p.relative_to(ROOT).parts)  # that one has rules of its own
REFUSED = {
    "collect to the driver": r"\.(collect|toPandas|toLocalIterator|take|tail|show)\(",
    "row-at-a-time Python": r"\b(udf|pandas_udf|mapPartitions|applyInPandas|mapInPandas)\b",
    "RDD": r"\.rdd\b",
    "forced broadcast": r"\bbroadcast\(",
    "cross join": r"crossJoin",
    "local checkpoint": r"localCheckpoint",
}


@pytest.mark.parametrize("path", LIBRARY, ids=lambda p: p.name)
def test_library_rules(path):
    text = path.read_text()
    # Allowed: a lookup table that was counted, and one row per partition.
    text = text.replace("F.broadcast(fixed) if fixed.count() <= max_rows", "").replace("F.broadcast(offsets)", "")
    for rule, pattern in REFUSED.items():
        assert not re.search(pattern, text), rule
