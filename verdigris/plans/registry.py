"""Queries of the analytics engine, by name, with the SQL each is checked against."""

from __future__ import annotations

from importlib import import_module

_PARTS = ("selection_queries", "proxy_queries", "detection_queries", "corpus_queries", "kernel_queries", "rebuild_queries")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in _PARTS:
    _module = import_module(f"{__package__}.{_part}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
