"""Queries of the training-data operators: name -> callable, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import funnelyard

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once for each application: their Python workers import its modules."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        home = os.path.dirname(os.path.dirname(os.path.abspath(funnelyard.__file__)))
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "funnelyard_package"), "zip", home, "funnelyard"))
        _SHIPPED.add(sc.applicationId)


def register(name: str, oracle: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query
    return deco
