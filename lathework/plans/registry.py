"""All core queries and their SQL."""

from __future__ import annotations

from lathework.plans import corpus, records, search, snapshots

MODULES = [search, records, snapshots, corpus]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
