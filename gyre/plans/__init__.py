"""Registered queries: each runs one operator over the given tables, with its SQL oracle."""

from gyre.plans.registry import oracles, queries

__all__ = ["oracles", "queries"]
