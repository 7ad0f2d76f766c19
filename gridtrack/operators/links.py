"""Links between elements of consecutive frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrack.config import TrackConfig
from gridtrack.functions.geo import edge_weight
from gridtrack.operators.elements import node_frame, node_number
from gridtrack.operators.raster import Raster
from gridtrack.session import stage


@dataclass(frozen=True)
class Graph:
    """``nodes`` (elements with a link) and ``edges(src, dst, overlap_px, pct, area, weight)``."""

    nodes: DataFrame
    edges: DataFrame


def overlap_pairs(elements: DataFrame, pixels: DataFrame, config: TrackConfig,
                  frames: DataFrame | None = None) -> DataFrame:
    """Element pairs of frames t-1, t that share cells, with the shared share and area.

    One hash join on ``(frame, r, c)``: a key holds only the elements covering
    one cell of one frame, so it stays small whatever the frame sizes are.  The
    counts are combined before the pairs are shuffled.
    """
    current = pixels.select("frame", "r", "c", F.col("ce_no").alias("dst_no"))
    earlier = pixels.select((F.col("frame") + 1).alias("frame"), "r", "c", F.col("ce_no").alias("src_no"))
    shared = (
        current.join(earlier, ["frame", "r", "c"])
        .groupBy("frame", "src_no", "dst_no").agg(F.count(F.lit(1)).alias("overlap_px"))
        .select(
            _key(F.col("frame") - 1, "src_no").alias("src"), _key(F.col("frame"), "dst_no").alias("dst"),
            "overlap_px",
        )
    )
    if config.require_contiguous_time:
        shared = _contiguous(shared, frames, config)
    size = elements.select("node", "n_px")
    share = F.greatest(F.col("overlap_px") / F.col("src_px"), F.col("overlap_px") / F.col("dst_px"))
    return (
        shared
        .join(size.select(F.col("node").alias("src"), F.col("n_px").alias("src_px")), "src")
        .join(size.select(F.col("node").alias("dst"), F.col("n_px").alias("dst_px")), "dst")
        .select("src", "dst", "overlap_px", share.alias("pct"),
                (F.col("overlap_px") * F.lit(config.cell_area)).alias("area"))
    )


def _key(frame, number):
    return F.shiftleft(frame.cast("bigint"), 32).bitwiseOR(F.col(number).cast("bigint"))


def _contiguous(pairs: DataFrame, frames: DataFrame, config: TrackConfig) -> DataFrame:
    """Drop pairs whose frames are further apart than one time step."""
    if frames is None:
        raise ValueError("require_contiguous_time needs the frame table")
    step = F.expr(f"interval '{int(config.tres * 3600)}' second")
    following = frames.select((F.col("frame") - 1).alias("frame"), F.col("ts").alias("next_ts"))
    steady = frames.join(following, "frame").where(F.col("next_ts") == F.col("ts") + step).select("frame")
    return (
        pairs.withColumn("frame", node_frame("src")).join(steady, "frame", "left_semi").drop("frame")
    )


def weighted_edges(pairs: DataFrame, config: TrackConfig) -> DataFrame:
    """Overlaps strong enough to be links, with their weight 1, 2 or 3."""
    return (
        pairs.withColumn("weight", edge_weight("pct", "area", config.min_overlap))
        .where(F.col("weight").isNotNull())
    )


def linked_elements(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements with at least one link; isolated ones are dropped."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return elements.join(ends, "node", "left_semi")


def build_graph(elements: DataFrame, pixels: DataFrame, config: TrackConfig,
                raster: Raster | None = None) -> Graph:
    frames = raster.frames if raster is not None else None
    edges = stage(weighted_edges(overlap_pairs(elements, pixels, config, frames), config), "edges")
    return Graph(linked_elements(elements, edges), edges)


def readable_edges(edges: DataFrame) -> DataFrame:
    """Edges with frame and element numbers instead of node keys."""
    extra = [x for x in edges.columns if x not in ("src", "dst")]
    return edges.select(
        node_frame("src").alias("src_frame"), node_number("src").alias("src_no"),
        node_frame("dst").alias("dst_frame"), node_number("dst").alias("dst_no"), *extra,
    )


def frame_counts(elements: DataFrame, edges: DataFrame, frames: DataFrame) -> DataFrame:
    """Elements and incoming links per frame, and the same with frames 1 and 2 merged.

    ``total`` and ``linked`` follow the published counter: it has no entry of
    its own for the first frame and counts links, not elements, so ``rejected``
    may be negative.  ``n_linked`` is the plain count of linked elements.
    """
    per_frame = elements.groupBy("frame").agg(F.count(F.lit(1)).alias("n_elements"))
    incoming = edges.groupBy(node_frame("dst").alias("frame")).agg(
        F.count(F.lit(1)).alias("n_edges"), F.countDistinct("dst").alias("n_linked"))
    merged = (
        frames.select("frame").join(per_frame, "frame", "left").join(incoming, "frame", "left")
    )
    return (
        merged.withColumn("frame", F.greatest("frame", F.lit(2)))
        .groupBy("frame")
        .agg(
            F.coalesce(F.sum("n_elements"), F.lit(0)).alias("total"),
            F.coalesce(F.sum("n_edges"), F.lit(0)).alias("linked"),
            F.coalesce(F.sum("n_linked"), F.lit(0)).alias("n_linked"),
        )
        .withColumn("rejected", F.col("total") - F.col("linked"))
    )


def graph_rows(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per link, ready for the JSON graph: the element and one parent.

    Rows are kept per link so that an element with very many parents is not
    gathered; ``sinks.text.graph_json`` folds bounded groups.
    """
    parents = edges.select(F.col("dst").alias("node"), F.col("src").alias("parent"))
    return elements.join(parents, "node").withColumn(
        "edge", F.concat(F.lit("F"), node_frame("parent").cast("string"),
                         F.lit("CE"), node_number("parent").cast("string")))
