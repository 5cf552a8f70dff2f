"""Every query of the engine by its name, and the SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cubes, stateful, streams  # noqa: F401  (importing them registers their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(cubes.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(cubes.SQL)
