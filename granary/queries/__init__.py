"""Queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("evidence", "records", "packages", "readings", "reports")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(f"granary.queries.{m}").QUERIES.items()}


def all_oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"granary.queries.{m}").ORACLE.items()}
