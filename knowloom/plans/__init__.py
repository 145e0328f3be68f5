"""Registered queries of the core: name -> (spark, sf_dir) -> DataFrame, and the SQL they are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this package that hold QUERIES and SQL.
MODULES = ("references", "functions", "search", "memory", "graph", "lifecycle", "code", "more", "records")


def core_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for m in MODULES:
        found |= importlib.import_module(f"{__name__}.{m}").QUERIES
    return found


def core_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in MODULES:
        found |= importlib.import_module(f"{__name__}.{m}").SQL
    return found
