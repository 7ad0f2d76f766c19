"""Comparison of two runs.

Cells are compared through digests: a digest per element and tile, digests of
frames and of parts of the run above them.  Equal runs exchange digests only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrack.session import stage


def only_in_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present in one run only, with the side that has them."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return (
        a.join(b, keys, "left_anti").withColumn("only_in", F.lit("left"))
        .unionByName(b.join(a, keys, "left_anti").withColumn("only_in", F.lit("right")))
    )


def value_differences(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cells whose values differ, paired by key; an absent cell counts as 0."""
    a = left.select(*keys, F.col(value).alias("left_value"))
    b = right.select(*keys, F.col(value).alias("right_value"))
    zero = F.lit(0)
    return (
        a.join(b, keys, "full_outer")
        .withColumn("difference", F.coalesce("left_value", zero) - F.coalesce("right_value", zero))
        .where(F.col("difference") != 0)
    )


# --- digests -------------------------------------------------------------------------------------

TILE = 64
PART_FRAMES = 64
ELEMENT, LEAF = ["frame", "ce_no"], ["part", "frame", "ce_no", "tr", "tc"]
#: from parts of a run to the tiles of its elements
LEVELS = [["part"], ["part", "frame"], LEAF]


def leaf_digests(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """A digest for every element and tile of ``pixels(frame, ce_no, r, c, tb)``, whatever the order of rows.

    Tasks combine their rows first, so what is shuffled is a row per tile.
    """
    cell = (F.col("r"), F.col("c"), F.col("tb").cast("double"))
    return pixels.groupBy(
        F.expr(f"frame div {PART_FRAMES}").cast("int").alias("part"), "frame", "ce_no",
        F.expr(f"r div {tile}").cast("int").alias("tr"), F.expr(f"c div {tile}").cast("int").alias("tc"),
    ).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*cell)).alias("mixed"),
          F.sum(F.pmod(F.xxhash64(F.lit("sum"), *cell), F.lit(2**40))).alias("total"))


def _rolled(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Digests of the parts, or frames, that the leaves belong to."""
    if keys == LEAF:
        return leaves
    own = F.xxhash64(*LEAF, "n", "mixed", "total")
    return leaves.groupBy(*keys).agg(F.sum("n").alias("n"), F.bit_xor(own).alias("mixed"), F.sum(F.pmod(own, F.lit(2**40))).alias("total"))


def differing_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tiles of elements that are not the same in both runs, found from the top of the digests down."""
    found = None
    for keys in LEVELS:
        a, b = _rolled(left, keys), _rolled(right, keys)
        a, b = (x.select(*keys, F.struct("n", "mixed", "total").alias(name)) for x, name in ((a, "a"), (b, "b")))
        found = stage(a.join(b, keys, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys), "digests-differ")
        if found.isEmpty():
            return left.select(*LEAF).limit(0)
        left, right = (x.join(found, keys, "left_semi") for x in (left, right))
    return found


def compare_elements(left: DataFrame, right: DataFrame, tile: int = TILE, digests: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Per element of either run: number of differing cells and the largest difference.

    Digests say where the runs differ, and only cells of those tiles are joined;
    ``digests`` are those of ``leaf_digests`` where the runs have stored them.
    """
    if digests is None:
        digests = tuple(stage(leaf_digests(x, tile), "digests") for x in (left, right))
    either = digests[0].select(*ELEMENT).unionByName(digests[1].select(*ELEMENT)).distinct()
    leaves = differing_leaves(*digests)
    if leaves.isEmpty():
        return either.select(*ELEMENT, F.lit(0).cast("bigint").alias("n_different"), F.lit(0).alias("max_difference"))

    def open_tiles(pixels: DataFrame) -> DataFrame:
        tiled = pixels.withColumn("tr", F.expr(f"r div {tile}").cast("int")).withColumn("tc", F.expr(f"c div {tile}").cast("int"))
        return tiled.join(leaves.drop("part"), [*ELEMENT, "tr", "tc"], "left_semi")

    differing = value_differences(open_tiles(left), open_tiles(right), [*ELEMENT, "r", "c"], "tb").groupBy(*ELEMENT).agg(
        F.count(F.lit(1)).alias("n_different"), F.max(F.abs("difference")).alias("max_difference"))
    return either.join(differing, ELEMENT, "left").select(
        *ELEMENT, F.coalesce("n_different", F.lit(0)).alias("n_different"),
        F.coalesce(F.col("max_difference").cast("int"), F.lit(0)).alias("max_difference"))
