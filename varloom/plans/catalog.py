"""All registered queries over the derived genotype tables, and the SQL that states
their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varloom.plans import calls, coordinates, files, merging, pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (calls, coordinates, merging, pairs, files):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
