"""Registered queries: name -> (spark callable, oracle SQL or None).

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame built
from the driver tables; the oracle is an independent SQL statement over the
same tables (DuckDB dialect).  Operators that cannot be expressed in SQL
register ``None`` and are checked on row counts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every query module so its ``@register`` calls run."""
    from funnelyard.plans import (q_audit, q_catalog, q_clean, q_compare, q_drivers,  # noqa: F401
                                  q_entities, q_funnel, q_ingest, q_loads, q_metrics, q_periods)
