"""Collects the registered queries and their SQL from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Plan modules; each has QUERIES (name -> callable) and SQL (name -> text).
MODULES: tuple[str, ...] = ("flagship", "texts", "scores", "evidences", "evals", "states", "inputs", "extras", "digests", "governance", "adaptive", "indexes", "records", "decisions", "rulebooks")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"verdigris.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"verdigris.plans.{name}").SQL
    return found
