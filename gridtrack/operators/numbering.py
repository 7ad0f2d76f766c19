"""Row numbers inside a group without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, group: str, block: str, within: list[str], name: str) -> DataFrame:
    """Number the rows of each ``group`` by ``(block, *within)``, starting at 1.

    Rows are ranked inside ``(group, block)``; the blocks before them are
    counted from one row per block.  A group that holds most of the table is
    spread over its blocks.
    """
    before = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(group, block).agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    inside = Window.partitionBy(group, block).orderBy(*within)
    return (
        df.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [group, block])
        .withColumn(name, (F.col("_offset") + F.col("_rank")).cast("int"))
        .drop("_rank", "_offset")
    )
