"""Queries by name, with the SQL they are held against where there is any."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
MODULES = ["retrieval", "construction", "auditing", "repairing", "reading"]


def query(sql: str | None = None):
    """Registers a function (spark, folder) -> DataFrame under its own name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"foliant.plans.{m}")


def queries() -> dict[str, Callable]:
    load()
    return dict(QUERIES)
