"""All registered queries over the reference's operators, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and ORACLE.
MODULES: list[str] = ["ranking", "snippets", "relations", "events", "extraction", "streams", "context", "indexing", "jobs", "indexes", "contracts", "verify", "parts"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(f"corvane.plans.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(f"corvane.plans.{m}").ORACLE
    return out
