"""Registry of the named queries of the summary operators and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = ["cardinality", "membership", "frequency", "quantiles", "similarity", "streaming", "rest"]


def _all() -> list[tuple[str, Callable[[SparkSession, str], DataFrame], str | None]]:
    rows = []
    for name in _MODULES:
        rows += importlib.import_module(f"gistra.plans.{name}").QUERIES
    return rows


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn, _ in _all()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _all() if sql}
