"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key, where ``groups[size]`` counts the rows of the key.

    Keys that hold at least one in ``HOT_SHARE`` of ``total`` rows are joined by
    broadcast: there can be at most ``HOT_SHARE`` of them, whatever the data.  No
    other key can fill a shuffle partition.  Both inputs should be stage tables,
    as each is read twice.
    """
    hot = groups.where(F.col(size) * HOT_SHARE >= F.lit(total))
    cold = groups.where(F.col(size) * HOT_SHARE < F.lit(total))
    spread = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return spread.unionByName(rest)
