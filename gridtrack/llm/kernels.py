"""How vectorised kernels get to the workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from gridtrack.session import ship_package


def in_tasks(rows: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``rows.mapInArrow(kernel, schema)`` on workers that have this package.

    A plan keeps the files that were shipped when it was built, so shipping comes first.
    """
    ship_package(rows.sparkSession)
    return rows.mapInArrow(kernel, schema)


def in_groups(rows: DataFrame, keys: list[str], kernel: Callable, schema: str) -> DataFrame:
    """``rows.groupBy(keys).applyInArrow(kernel, schema)``, shipped alike."""
    ship_package(rows.sparkSession)
    return rows.groupBy(*keys).applyInArrow(kernel, schema)
