"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from tallyfold.plans.tables import Query

MODULES = ("star", "schema_catalog", "dependency", "inventory", "bundle_sets", "site")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"tallyfold.plans.{name}"), attribute))
    return merged


def queries() -> dict[str, Query]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
