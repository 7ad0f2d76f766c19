"""Connected components of an undirected graph, as a distributed operator.

Alternating large-star / small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014).  Before each shuffle every task
contracts its own edges block by block, the graph counterpart of a map-side
combine, so long chains inside one block collapse without a round trip.  The
rounds work on minima and one-row-per-node tables only: no node's neighbour
list is ever gathered, however many edges a hub has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrack.operators.unionfind import smallest_members
from gridtrack.session import ship_package, stage, unstage

BLOCK_EDGES = 1_000_000
PAIR_SCHEMA = "scope bigint, node bigint, root bigint"


def components(edges: DataFrame) -> DataFrame:
    """Map every node of ``edges(scope, a, b)`` to the smallest node it is connected to.

    ``scope`` separates graphs that never touch.  Returns ``(scope, node, root)``
    with one row per node that has an edge; roots map to themselves.
    """
    pairs = stage(_contract(edges.select("scope", "a", "b")), "components")
    while not _settled(pairs):
        before, pairs = pairs, stage(_contract(_small_star(_large_star(pairs))), "components")
        unstage(before)
    members = pairs.select("scope", "node", "root")
    heads = pairs.select("scope", F.col("root").alias("node"), "root")
    return members.unionByName(heads).distinct()


def _large_star(pairs: DataFrame) -> DataFrame:
    """Point every node at the smallest neighbour of its current root."""
    inward = pairs.select("scope", F.col("node").alias("hub"), F.col("root").alias("near"))
    outward = pairs.select("scope", F.col("root").alias("hub"), F.col("node").alias("near"))
    lowest = (
        inward.unionByName(outward).groupBy("scope", "hub")
        .agg(F.least(F.min("near"), F.col("hub")).alias("low"))
    )
    return (
        pairs.join(lowest.withColumnRenamed("hub", "root"), ["scope", "root"])
        .select("scope", "node", F.col("low").alias("root"))
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """Connect all smaller neighbours of a node to the smallest of them."""
    lowest = pairs.groupBy("scope", "node").agg(F.min("root").alias("low"))
    own = lowest.select("scope", "node", F.col("low").alias("root"))
    others = (
        pairs.join(lowest, ["scope", "node"]).where(F.col("root") > F.col("low"))
        .select("scope", F.col("root").alias("node"), F.col("low").alias("root"))
    )
    return own.unionByName(others)


def _settled(pairs: DataFrame) -> bool:
    """True when every node has one root and no root hangs below another."""
    torn = (
        pairs.groupBy("scope", "node").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        .where("lo < hi").select("scope")
    )
    inner = pairs.select("scope", F.col("node").alias("root")).distinct()
    chained = pairs.join(inner, ["scope", "root"], "left_semi").select("scope")
    return torn.unionByName(chained).isEmpty()


def _contract(edges: DataFrame) -> DataFrame:
    """Replace the edges of each block by a star around the block's smallest nodes.

    The rebalance puts nearby nodes (64 frames or raster rows) together; AQE
    splits a crowded partition, and a task holds one block at a time.
    """
    ship_package(edges.sparkSession)
    scope, a, b = edges.columns
    near = edges.select(
        F.col(scope).alias("scope"), F.col(a).alias("a"), F.col(b).alias("b"),
        F.shiftright(F.col(a), 38).alias("zone"),
    ).hint("rebalance", F.col("scope"), F.col("zone"))
    return near.drop("zone").mapInArrow(_contract_blocks, PAIR_SCHEMA)


def _contract_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_EDGES:
            yield _stars(held)
            held, rows = [], 0
    if rows:
        yield _stars(held)


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    scope, a, b = (table.column(i).to_numpy() for i in range(3))
    scopes, nodes = np.concatenate([scope, scope]), np.concatenate([a, b])
    order = np.lexsort((nodes, scopes))
    scopes, nodes = scopes[order], nodes[order]
    fresh = np.r_[True, (np.diff(nodes) != 0) | (np.diff(scopes) != 0)]
    code = np.empty(order.size, dtype=np.int64)
    code[order] = np.cumsum(fresh) - 1
    scopes, nodes = scopes[fresh], nodes[fresh]
    low = smallest_members(nodes.size, code[: a.size], code[a.size:])
    child = low != np.arange(nodes.size)
    return pa.RecordBatch.from_arrays(
        [pa.array(scopes[child]), pa.array(nodes[child]), pa.array(nodes[low[child]])],
        names=["scope", "node", "root"],
    )
