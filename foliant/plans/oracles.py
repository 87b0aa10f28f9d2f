"""SQL by query name."""

from __future__ import annotations

from foliant.plans import registry


def oracle_sql() -> dict[str, str]:
    registry.load()
    return dict(registry.SQL)
