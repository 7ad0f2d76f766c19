"""Systems: components of the pruned graph, their members, stages and complexes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrack.config import TrackConfig
from gridtrack.operators.candidates import assign_candidates
from gridtrack.operators.components import components
from gridtrack.operators.elements import element_id, node_frame, node_number
from gridtrack.operators.labeling import label_pixels, region_summary
from gridtrack.operators.links import Graph
from gridtrack.operators.numbering import number_rows
from gridtrack.operators.paths import Clusters, behaviours, component_sizes, graph_components
from gridtrack.session import stage

OUTER, INNER = 0, 1


@dataclass(frozen=True)
class Systems:
    """``members`` of all systems (MCS) and complexes (MCC), and per-node ``stages``."""

    members: DataFrame
    stages: DataFrame


def system_members(pruned: DataFrame, config: TrackConfig) -> DataFrame:
    """``(node, component)`` of pruned components with more members than the minimum."""
    members = stage(graph_components(pruned), "pruned-members")
    big = component_sizes(members).where(F.col("n_nodes") > config.min_mcs_duration).select("component")
    return members.join(big, "component", "left_semi")


def criteria_areas(elements: DataFrame, pixels: DataFrame, config: TrackConfig) -> DataFrame:
    """Area of each element's largest connected part below the outer and inner temperature.

    Only elements as large as the outer shield are examined.  Both temperatures are
    labelled in one pass; a scope is one element and one of them, so regions never
    cross elements and a large element is many tiles.
    """
    own = _large_element_pixels(elements, pixels, config).where(F.col("tb") < config.outer_temperature)
    regions = region_summary(own.withColumnRenamed("node", "scope"), config.tile, (config.outer_temperature, config.inner_temperature))
    cell = F.lit(config.cell_area)
    level = F.col("scope").bitwiseAND(F.lit(1))
    return regions.groupBy(F.shiftright("scope", 1).alias("node")).agg(
        F.coalesce(F.max(F.when(level == OUTER, F.col("n"))) * cell, F.lit(0.0)).alias("outer_part"),
        F.coalesce(F.max(F.when(level == INNER, F.col("n"))) * cell, F.lit(0.0)).alias("inner_part"),
    )


def criterion_b_pixels(elements: DataFrame, pixels: DataFrame, config: TrackConfig) -> DataFrame:
    """``(node, r, c, tb)`` of each large element's largest part below the inner temperature."""
    own = _large_element_pixels(elements, pixels, config).where(F.col("tb") < config.inner_temperature)
    labelled = label_pixels(own.withColumnRenamed("node", "scope"), config.tile)
    largest = (
        labelled.groupBy("scope", "label").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("scope").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    )
    return labelled.join(largest, ["scope", "label"], "left_semi").select(
        F.col("scope").alias("node"), "r", "c", "tb")


def _large_element_pixels(elements: DataFrame, pixels: DataFrame, config: TrackConfig) -> DataFrame:
    large = elements.where(F.col("area") >= config.outer_area).select("frame", "ce_no", "node")
    return pixels.join(large, ["frame", "ce_no"])


def find_systems(graph: Graph, clusters: Clusters, pixels: DataFrame, config: TrackConfig) -> Systems:
    """Systems, complexes, behaviours and stages.

    Only the assignment of members to candidates depends on a visiting order;
    membership, merging and confirmation are joins and aggregations.
    """
    members = stage(system_members(clusters.edges, config), "systems")
    described = graph.nodes.select("node", "frame", "ce_no", "area", "eccentricity").join(members, "node")
    areas = criteria_areas(described, pixels, config)
    nodes = stage(
        described.join(areas, "node", "left").fillna(0.0, ["outer_part", "inner_part"])
        .select("component", "node", "area", "eccentricity", "outer_part", "inner_part"), "system-nodes")
    links = clusters.edges.join(members.withColumnRenamed("node", "src"), "src").select("component", "src", "dst")
    placed, candidates = assign_candidates(nodes, links, config)
    joined = stage(join_candidates(placed, candidates, graph.edges, config), "joined-candidates")
    stages = member_stages(nodes, placed, joined)
    complexes = confirmed_complexes(nodes, placed, joined, config)

    everyone = members.select("node", F.col("component").alias("feature_id"), F.lit("MCS").alias("kind"))
    listed = (
        everyone.unionByName(complexes.withColumn("kind", F.lit("MCC")))
        .join(behaviours(clusters.edges).select("node", "behaviour"), "node")
        .join(stages, "node", "left")
        .withColumn("frame", node_frame("node")).withColumn("ce_no", node_number("node"))
        .withColumn("id", element_id("frame", "ce_no"))
        .withColumn("feature", F.concat("kind", F.lit(":"), F.col("feature_id").cast("string")))
    )
    ordered = number_rows(listed, "feature", "frame", ["ce_no"], "seq").drop("feature")
    return Systems(stage(ordered, "feature-members"), stages)


def join_candidates(placed: DataFrame, candidates: DataFrame, edges: DataFrame, config: TrackConfig) -> DataFrame:
    """``(component, cand, run, last_core)`` of candidates that last long enough.

    A candidate continues the one before it when the last core member there is
    linked to its own first one in the full graph; ``run`` is the first of the
    merged candidates and durations add up.
    """
    cores = placed.where("core").groupBy("component", "cand").agg(
        F.min("node").alias("first_core"), F.max("node").alias("last_core"))
    ends = cores.select("component", (F.col("cand") + 1).alias("cand"), F.col("last_core").alias("previous"))
    continued = stage(
        cores.join(ends, ["component", "cand"])
        .join(edges.select(F.col("src").alias("previous"), F.col("dst").alias("first_core")), ["previous", "first_core"])
        .select(F.col("component").alias("scope"), (F.col("cand") - 1).alias("a"), F.col("cand").alias("b")),
        "continued")
    runs = candidates.join(cores, ["component", "cand"], "left").withColumn("run", F.col("cand"))
    if not continued.isEmpty():
        starts = components(continued).select(
            F.col("scope").alias("component"), F.col("node").alias("cand"), "root")
        runs = runs.join(starts, ["component", "cand"], "left").withColumn("run", F.coalesce("root", "cand"))
    lasting = runs.groupBy("component", "run").agg(
        F.sum("duration").alias("length"), F.max("last_core").alias("run_core"))
    hours = F.col("length") * config.tres
    lasting = lasting.where(
        hours.between(config.minimum_duration, config.maximum_duration) & F.col("run_core").isNotNull())
    return runs.select("component", "run", "cand").join(lasting, ["component", "run"]).select(
        "component", "cand", "run", F.col("run_core").alias("last_core"))


def member_stages(nodes: DataFrame, placed: DataFrame, joined: DataFrame) -> DataFrame:
    """``(node, stage)``: the candidate's stage; unplaced members after a lasting core decay."""
    ends = joined.groupBy("component").agg(F.min("last_core").alias("first_end"))
    late = F.when(F.col("node") > F.col("first_end"), "D")
    return (
        nodes.select("component", "node").join(placed.select("node", "stage"), "node", "left")
        .join(ends, "component", "left")
        .select("node", F.coalesce("stage", late).alias("stage")).where(F.col("stage").isNotNull())
    )


def confirmed_complexes(nodes: DataFrame, placed: DataFrame, joined: DataFrame, config: TrackConfig) -> DataFrame:
    """``(node, feature_id)``: members of the runs whose largest grown member is round enough."""
    bodies = placed.join(joined, ["component", "cand"]).join(
        nodes.select("node", "area", "eccentricity"), "node")
    grown = F.col("stage").isin("M", "D") & (F.col("area") > 0)
    shape = F.max_by("eccentricity", F.when(grown, F.struct("area", -F.col("node"))))
    round_runs = bodies.groupBy("component", "run").agg(
        F.min("node").alias("feature_id"), F.max(grown).alias("any_grown"), shape.alias("shape")
    ).where(F.col("any_grown") & F.col("shape").between(config.eccentricity_min, config.eccentricity_max))
    return bodies.join(round_runs, ["component", "run"]).select("node", "feature_id")
