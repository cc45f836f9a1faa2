"""Named queries over the given tables and their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

from . import base

_MODULES = ("queries_text", "queries_structure", "queries_chunks", "queries_retrieval", "queries_guard", "queries_conversations", "queries_quality", "queries_stores", "queries_engine")


def _load() -> None:
    for m in _MODULES:
        import_module(f"{__name__}.{m}")


def queries():
    _load()
    return dict(base.QUERIES)


def oracle_sql():
    _load()
    return dict(base.ORACLES)
