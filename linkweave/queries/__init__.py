"""Named queries over the test tables, and the SQL that gives the same results."""

from __future__ import annotations

from importlib import import_module

MODULES = ("skew", "scalars", "links", "files")


def _all(name: str) -> dict:
    out = {}
    for m in MODULES:
        out |= getattr(import_module(f"linkweave.queries.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
