"""Query catalog: every registered operator query with its oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame`` over the input tables.  The
oracle is an independent DuckDB SQL statement over the same tables; queries whose
semantics are not expressible in SQL (model training, streams) register none and
are checked by unit tests instead.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    fn: QueryFn
    sql: str | None


_REGISTRY: dict[str, Entry] = {}

MODULES = (
    "terroir.plans.q_profile",
    "terroir.plans.q_validate",
    "terroir.plans.q_clean",
    "terroir.plans.q_features",
    "terroir.plans.q_evaluate",
    "terroir.plans.q_rules",
    "terroir.plans.q_spatial",
    "terroir.plans.q_time",
    "terroir.plans.q_more",
    "terroir.plans.q_scoring",
    "terroir.plans.q_io",
    "terroir.plans.q_ml",
    "terroir.plans.q_stream",
)


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Entry(name, fn, sql)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    for m in MODULES:
        importlib.import_module(m)
    return dict(sorted(_REGISTRY.items()))


def queries() -> dict[str, QueryFn]:
    return {k: e.fn for k, e in load_all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.sql for k, e in load_all().items() if e.sql is not None}
