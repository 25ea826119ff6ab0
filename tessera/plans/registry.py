"""Every registered query of the library proper, with its oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"]
_engines: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, sf_dir: str, sql: str) -> Engine:
    """One engine an application and folder, with the tables that the SQL names."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        _engines[key] = Engine(spark)
    own = _engines[key]
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql) and not own.has(name):
            own.register_parquet(name, f"{sf_dir}/{name}.parquet")
    return own


def by_sql(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, sql).query(sql)


def _modules():
    from . import aggregates, events, files, nested, relational, reporting, scalar, storage, tables, tpch, windows

    return (tpch, relational, aggregates, windows, scalar, nested, events, storage, tables, files, reporting)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for module in _modules():
        for name, (query, _) in module.QUERIES.items():
            out[name] = by_sql(query) if isinstance(query, str) else query
    return out


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, (_, sql) in module.QUERIES.items() if sql}
