"""How a query and its oracle are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varloom.sources.fixtures import derive, with_views


def registry() -> tuple[dict, dict, Callable]:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def add(name: str, tables: str, build: Callable[..., DataFrame], sql: str | None) -> None:
        """``build`` takes the named tables as DataFrames, in order."""
        names = tables.split()
        queries[name] = lambda spark, sf_dir: build(*(derive(spark, sf_dir, n) for n in names))
        if sql is not None:
            oracles[name] = with_views(names, sql)

    return queries, oracles, add
