"""Collects the core's queries and their SQL."""

from __future__ import annotations

from . import analytics, catalog, details, io, ml, problems, ranking, search, selection, sessions, vectors

MODULES = (problems, analytics, sessions, ranking, vectors, search, catalog, ml, io, selection, details)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
