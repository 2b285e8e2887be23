"""Query registry: SURVEY §2 id → (Spark callable, DuckDB oracle text).

Each registered callable takes ``(spark, sf_dir)`` and returns a DataFrame over
the whole tables of that directory.  The oracle is the same question written in
DuckDB SQL over the driver's views, prefixed with the probe-view CTEs it uses.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from meshlens.plans.oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Entry] = {}

_MODULES = (
    "meshlens.plans.search_queries",
    "meshlens.plans.relational_queries",
    "meshlens.plans.aggregate_queries",
    "meshlens.plans.text_queries",
    "meshlens.plans.link_queries",
    "meshlens.plans.graph_queries",
    "meshlens.plans.quality_queries",
    "meshlens.plans.lifecycle_queries",
    "meshlens.plans.refresh_queries",
    "meshlens.plans.resolution_queries",
    "meshlens.plans.filter_queries",
    "meshlens.plans.config_queries",
    "meshlens.plans.misc_queries",
    "meshlens.plans.structure_queries",
)


def register(name: str, sql: str | None = None):
    """Decorator: register a query under ``name`` with its oracle SQL body."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, with_views(sql) if sql else None)
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as e:  # modules are added step by step
            if e.name != m:
                raise


def queries() -> dict[str, QueryFn]:
    _load()
    return {n: e.fn for n, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: e.sql for n, e in REGISTRY.items() if e.sql}
