"""Registry of named queries and their DuckDB oracles.

Every query takes ``(spark, sf_dir)``, reads whole driver tables and
returns a DataFrame whose column names match its oracle's.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelane.plans import flows, oracles, record_queries, telemetry_queries, text_queries
from pagelane.session import apply_runtime_conf

_REGISTRY: dict[str, tuple] = {
    "invoice_documents": (flows.invoice_documents, oracles.invoice_documents),
}
for _group in (text_queries.QUERIES, record_queries.QUERIES, telemetry_queries.QUERIES):
    _REGISTRY.update(_group)


def _with_conf(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_runtime_conf(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _with_conf(fn) for name, (fn, _) in _REGISTRY.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: build() for name, (_, build) in _REGISTRY.items() if build is not None}
