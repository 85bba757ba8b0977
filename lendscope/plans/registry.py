"""Query registry: name -> (Spark builder, DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, list[str]] = {}   # query name -> SURVEY operator ids it exercises


def register(name: str, sql: str | None = None, ops: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        OPERATORS[name] = list(ops)
        return fn
    return deco


PLAN_MODULES = ("book", "quality", "monitoring", "stats", "drift", "catalog_misc", "alerts", "streams", "training")


def load_all() -> None:
    """Import every plan module so that its queries register (idempotent)."""
    import importlib
    for mod in PLAN_MODULES:
        importlib.import_module(f"lendscope.plans.{mod}")
