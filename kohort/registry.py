"""Registered queries: name -> (Spark builder(spark, sf_dir), DuckDB oracle SQL or None).

Every query reads the given tables (or the screening views Spark derives from
them) in full. Oracle SQL restates the semantics independently in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def _load_all():
    # Importing the query modules fills REGISTRY.
    from kohort.plans import queries_clean, queries_stats, queries_cluster, queries_map, queries_batches, queries_more  # noqa: F401


def queries() -> dict:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
