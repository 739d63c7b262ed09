"""All queries of the library proper: name -> (callable, SQL or None)."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark import plans

FLAGSHIP = "r4_lexical_search"


def _modules() -> list:
    return [importlib.import_module(f"quillspark.plans.{m.name}") for m in pkgutil.iter_modules(plans.__path__)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _modules() for name, f in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in getattr(m, "SQL", {}).items()}
