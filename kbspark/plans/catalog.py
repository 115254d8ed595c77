"""All registered queries."""

from __future__ import annotations

import importlib

from kbspark.plans.registry import ORACLE, QUERIES

MODULES = [
    "text", "privacy", "tables", "speech", "memory", "sessions", "retrieval", "graph", "operations", "streams",
]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"kbspark.plans.{name}_queries")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLE)
