"""All registered queries of the engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftfield.plans import diagnostics, interactions, overdamped, tables, underdamped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (overdamped, underdamped, tables, interactions, diagnostics):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
