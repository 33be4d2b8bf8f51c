"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from gyre.functions.guards import rounded
from gyre.plans.views import Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

FAMILIES = (
    "sequence_queries",
    "trace_queries",
    "support_queries",
    "pixel_queries",
    "region_queries",
    "profile_queries",
    "pairing_queries",
    "evidence_queries",
    "benchmark_queries",
    "catalogue_queries",
    "source_queries",
    "stream_queries",
)


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`; floats are rounded to 6 digits."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Tables(spark, sf_dir)))

        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return register


def r6(expression: str) -> str:
    """SQL counterpart of the 6-digit rounding applied to every floating column."""
    return f"(round(CAST({expression} AS DOUBLE), 6) + 0.0)"


def _load() -> None:
    for family in FAMILIES:
        import_module(f"gyre.plans.{family}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
