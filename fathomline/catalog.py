"""The registry of queries and their SQL oracles.

Modules of ``plans`` register with ``@query(name, sql)``; importing this module imports them all.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PLANS = ("structured", "recall", "ranking", "relational", "paging", "text", "chunking", "tree", "quality", "reports", "control", "office", "assembly", "validation", "reading", "page_quality", "routing")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its oracle, None where SQL cannot express it."""

    def keep(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return keep


def load() -> None:
    for plan in PLANS:
        import_module(f"fathomline.plans.{plan}")
