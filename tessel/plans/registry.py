"""All registered queries: name, DataFrame function, equivalent SQL (or None), operator ids."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str


REGISTRY: dict[str, Query] = {}


def register(name: str, ids: str, sql: str | None = None):
    """Add a function (spark, sf_dir) to the registry under ``name``."""

    def add(run):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(run, sql, ids)
        return run

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: q.run for name, q in REGISTRY.items()}


def oracles() -> dict[str, str]:
    _load()
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}


def _load() -> None:
    """Import the modules that register queries."""
    from tessel.plans import evaluation, leakage, relational, sequences, songs  # noqa: F401
