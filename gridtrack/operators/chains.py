"""Linear chains of the pruned graph: ancestors and descendants up to the first fork.

A chain leaves a node while it has exactly one parent (or child).  Pointers are
doubled, so the number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrack.operators.paths import degrees
from gridtrack.session import stage

UP, DOWN = "up", "down"


def _pointers(edges: DataFrame, direction: str) -> DataFrame:
    """``(node, next)`` for nodes with exactly one link in the direction."""
    here, there = ("dst", "src") if direction == UP else ("src", "dst")
    return (
        edges.groupBy(F.col(here).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min(there).alias("next"))
        .where("n = 1").select("node", "next")
    )


def chain_ends(edges: DataFrame, direction: str = UP) -> DataFrame:
    """``(node, end, steps, n_links)``: where each node's chain stops and how many links are there."""
    counted = degrees(edges)
    hops = _pointers(edges, direction)
    jumps = stage(
        counted.select("node").join(hops, "node", "left").select(
            "node", F.coalesce("next", "node").alias("end"),
            F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("steps")),
        "chains")
    while True:
        onward = jumps.select(F.col("node").alias("end"), F.col("end").alias("far"), F.col("steps").alias("more"))
        moving = jumps.join(onward, "end")
        if moving.where("more > 0").isEmpty():
            break
        jumps = stage(moving.select("node", F.col("far").alias("end"), (F.col("steps") + F.col("more")).alias("steps")),
                      "chains")
    links = "n_parents" if direction == UP else "n_children"
    at_end = counted.select(F.col("node").alias("end"), F.col(links).alias("n_links"))
    return jumps.join(at_end, "end").select("node", "end", "steps", "n_links")


def chain_members(edges: DataFrame, starts: DataFrame, direction: str = UP) -> DataFrame:
    """``(start, step, node)``: the nodes on the chains of ``starts(node)``, nearest first."""
    jumps = stage(_pointers(edges, direction).withColumnRenamed("next", "far"), "chain-jumps")
    width = 1
    reached = starts.select(F.col("node").alias("start"), "node", F.lit(0).cast("bigint").alias("step"))
    while not jumps.isEmpty():
        further = (
            reached.join(jumps, "node")
            .select("start", F.col("far").alias("node"), (F.col("step") + width).alias("step"))
        )
        reached = stage(reached.unionByName(further), "chain-members")
        onward = jumps.select(F.col("node").alias("far"), F.col("far").alias("next"))
        jumps = stage(jumps.join(onward, "far").select("node", F.col("next").alias("far")), "chain-jumps")
        width *= 2
    return reached.where("step > 0").select("start", "step", "node")
