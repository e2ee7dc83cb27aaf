"""Registered queries with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerline.session import ship_package
from ledgerline.sources.tables import Tables


@dataclass(frozen=True)
class Entry:
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a query over `Tables`; `sql` is the DuckDB text that must give the same rows."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return add


def load() -> dict[str, Entry]:
    from ledgerline.plans.catalog import (  # noqa: F401  (registration by import)
        comparison, fundamentals, general, learning, market, news, targets,
    )

    return REGISTRY


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    entry = load()[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return entry.run(Tables(spark, sf_dir))

    return run
