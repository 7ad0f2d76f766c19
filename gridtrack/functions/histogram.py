"""Equal-width histograms over the value range, last bin closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """``(*by, bin, low, high, n, share)`` for every bin, empty ones included.

    Values are counted per bin before the shuffle; a range of width zero is
    widened by half a unit on both sides.
    """
    keys = by or ["_all"]
    rows = df.where(F.col(value).isNotNull()).select(
        *(keys if by else [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v"))
    limits = rows.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.count("_v").alias("_n"))
    flat = F.col("_a") == F.col("_b")
    limits = limits.select(
        *keys, "_n", F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_a"),
        F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_b"))

    def edge(i):
        return F.col("_a") + i * ((F.col("_b") - F.col("_a")) / bins)

    guess = F.least(F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1))
    placed = rows.join(limits, keys).withColumn("_g", guess)
    counts = (
        placed.withColumn(
            "bin",
            F.when(F.col("_v") < edge(F.col("_g")), F.col("_g") - 1)
            .when((F.col("_g") < bins - 1) & (F.col("_v") >= edge(F.col("_g") + 1)), F.col("_g") + 1)
            .otherwise(F.col("_g")).cast("int"))
        .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_c"))
    )
    every = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("_c", F.lit(0).cast("bigint"))
    return every.join(counts, [*keys, "bin"], "left").select(
        *(by or []), "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"),
        n.alias("n"), (n / F.col("_n")).alias("share"))
