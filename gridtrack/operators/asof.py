"""As-of join of two series with irregular times, by blocks of time.

A row takes the latest row of the other series that is not later than itself and
not older than a tolerance.  Time is cut into blocks; the only earlier rows that
can matter to a block are the last one of each block within the tolerance, so
these few are carried into it.  A group is one block of one key, whatever the
length of the series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], values: Sequence[str], tolerance: float,
              block: float | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """``left`` with ``right_ts`` and the ``values`` of the latest row of ``right`` within ``tolerance`` seconds before it.

    Both have ``ts`` and the key columns ``by``.  Rows without a match have nulls;
    a null time or key matches nothing.  Of rows of ``right`` at the same time the one that is
    largest by ``ties``, then by ``values``, counts.  ``block`` is the length of a block in seconds,
    the tolerance unless given; shorter blocks are smaller groups and carry more rows.
    """
    width = int((block or tolerance or 1) * 1e6)
    carried = math.ceil(tolerance * 1e6 / width)
    keys = list(by)
    order = list(dict.fromkeys([*ties, *values]))
    known = right.where(F.col("ts").isNotNull()).select(
        *keys, F.struct("ts", *order).alias("found"), F.floor(micros("ts") / width).alias("block"))
    # one row per time and key is enough, and the last one of a block for later blocks
    known = known.groupBy(*keys, "block", F.col("found.ts").alias("at")).agg(F.max("found").alias("found"))
    last = known.groupBy(*keys, "block").agg(F.max("found").alias("found"))
    later = last.select(*keys, F.explode(F.sequence(F.col("block") + 1, F.col("block") + carried)).alias("block"), "found") \
        if carried else last.limit(0).select(*keys, "block", "found")
    carry = later.groupBy(*keys, "block").agg(F.max("found").alias("found"))
    facts = known.select(*keys, "block", F.col("found.ts").alias("at"), "found").unionByName(
        carry.select(*keys, "block", F.col("found.ts").alias("at"), "found"))

    columns = [F.col(c).alias(f"l{i}") for i, c in enumerate(left.columns)]
    asking = left.select(*keys, F.floor(micros("ts") / width).alias("block"), F.col("ts").alias("at"), F.struct(*columns).alias("row"))
    both = asking.withColumn("found", F.lit(None).cast(facts.schema["found"].dataType)).unionByName(
        facts.withColumn("row", F.lit(None).cast(asking.schema["row"].dataType)))
    # rows of the other series come first at equal times
    series = Window.partitionBy(*keys, "block").orderBy("at", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    joined = both.withColumn("latest", F.last("found", ignorenulls=True).over(series)).where("row IS NOT NULL")
    named = F.lit(True)
    for key in keys:
        named = named & F.col(key).isNotNull()
    fresh = named & (micros("at") - micros("latest.ts") <= int(tolerance * 1e6))
    return joined.select(
        *[F.col(f"row.l{i}").alias(c) for i, c in enumerate(left.columns)],
        F.when(fresh, F.col("latest.ts")).alias("right_ts"),
        *[F.when(fresh, F.col(f"latest.{v}")).alias(v) for v in values])
