"""The engine's queries on the driver's tables, and the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("text_queries", "graph_queries", "twin_queries", "intake_queries", "catalog_queries")


def _each() -> list:
    return [import_module(f"driftnet.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in _each() for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _each() for k, v in m.SQL.items()}
