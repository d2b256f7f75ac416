"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("embeddings", "toxicity", "sharding", "substrings", "urls", "language_model", "packing", "decontamination", "language", "near_duplicates", "phrases", "variants", "quality")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged |= getattr(import_module(f"tallyfold.llm.{name}"), attribute)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
