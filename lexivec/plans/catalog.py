"""Query catalog: every registered query reads the driver tables under
``sf_dir`` and returns a DataFrame; most have an equivalent DuckDB SQL oracle.

Queries are grouped by module in ``lexivec.plans.q_*``; importing this module
registers all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with an
    optional oracle SQL string (omitted for non-SQL-expressible operators)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load_all() -> None:
    from lexivec.plans import q_text, q_tables, q_vectors, q_eval, q_features, q_misc, q_classifier  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
