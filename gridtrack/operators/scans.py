"""Running sums over series of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtrack.session import stage


def running_sum(rows: DataFrame, keys: Sequence[str], order: str, value: str, block: int = 256) -> DataFrame:
    """``rows`` with ``running``, the sum of ``value`` over rows of the same keys up to this place.

    ``order`` is a whole number of at least 0; rows at the same place count together.  Places are
    cut into blocks of ``block``: sums run inside a block, and what comes before it
    is the running sum of the blocks' totals, found alike.  No group is longer than a
    block, and the rounds grow with the logarithm of the series.  Null values add nothing.
    """
    keys = list(keys)
    rows = stage(rows, "running")
    last = rows.agg(F.max(order)).first()[0]
    inside = Window.partitionBy(*keys, "in block").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.withColumn("in block", F.expr(f"`{order}` div {block}"))
    within = cut.withColumn("running", F.coalesce(F.sum(value).over(inside), F.lit(0.0)))
    if last is None or last < block:
        return within.drop("in block")
    totals = cut.groupBy(*keys, F.col("in block").alias("block")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    upto = running_sum(totals, keys, "block", "total", block)
    before = upto.select(*keys, "block", (F.col("running") - F.col("total")).alias("before"))
    same = [within[a].eqNullSafe(before[b]) for a, b in [*zip(keys, keys), ("in block", "block")]]
    joined = within.join(before, same)
    return joined.select(*[within[c] for c in rows.columns], (within["running"] + before["before"]).alias("running"))
