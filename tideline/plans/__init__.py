"""Named queries: the library's operators over the given tables."""

from __future__ import annotations

import importlib

from .catalog import CHECKS, QUERIES

_MODULES = ("feed_queries", "table_queries", "document_queries", "stream_queries")


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"{__name__}.{module}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def checks() -> dict:
    _load()
    return dict(CHECKS)
