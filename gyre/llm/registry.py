"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "licences",
    "substrings",
    "site_quality",
    "chat",
    "near_duplicates",
    "decontamination",
    "language",
    "toxicity",
    "mixing",
    "vectors",
    "ranked_search",
    "sharding",
    "collocations",
)


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"gyre.llm.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
