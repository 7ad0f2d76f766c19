"""The whole analysis: grid in, systems and their measures out."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrack.config import TrackConfig
from gridtrack.operators.elements import Elements, find_elements
from gridtrack.operators.links import Graph, build_graph
from gridtrack.operators.metrics import feature_nodes
from gridtrack.operators.paths import Clusters, prune, pruned_nodes
from gridtrack.operators.precip import attach_rain, element_rain
from gridtrack.operators.raster import Raster
from gridtrack.operators.systems import Systems, find_systems
from gridtrack.session import stage


@dataclass(frozen=True)
class Analysis:
    raster: Raster
    elements: Elements
    graph: Graph
    clusters: Clusters
    systems: Systems
    rain: DataFrame | None

    def nodes(self, kind: str | None = None) -> DataFrame:
        """Members of the systems with the columns of their elements."""
        return feature_nodes(self.systems.members, self.elements.accepted, kind)


def elements_with_pixels(raster: Raster, config: TrackConfig) -> Elements:
    """Elements whose pixel table is materialized: links, criteria and rain all read it."""
    found = find_elements(raster, config)
    return Elements(found.accepted, found.rejected, stage(found.pixels, "element-pixels"))


def with_rain(elements: Elements, source: DataFrame, raster: Raster,
              config: TrackConfig, axes: DataFrame | None = None) -> tuple[Elements, DataFrame]:
    found = element_rain(elements.pixels, source, raster, tolerance=config.rain_tolerance, fold=config.fold_longitudes, axes=axes)
    rain = stage(found, "element-rain")
    wet = stage(attach_rain(elements.accepted, rain, config), "elements-rain")
    return Elements(wet, elements.rejected, elements.pixels), rain


def analyse(raster: Raster, config: TrackConfig, rain_source: DataFrame | None = None,
            timings: dict[str, float] | None = None) -> Analysis:
    """Run all stages; ``timings`` collects the seconds of each."""
    clock = _Clock(timings)
    elements = elements_with_pixels(raster, config)
    rain = None
    if rain_source is not None:
        elements, rain = with_rain(elements, rain_source, raster, config)
    clock.mark("elements")
    graph = build_graph(elements.accepted, elements.pixels, config, raster)
    clock.mark("links")
    clusters = prune(graph.edges, config)
    clock.mark("clusters")
    systems = find_systems(graph, clusters, elements.pixels, config)
    clock.mark("systems")
    return Analysis(raster, elements, graph, clusters, systems, rain)


def run_record(analysis: Analysis, timings: dict[str, float]) -> dict:
    """Counts and stage seconds of a run, as plain values for a JSON report."""
    counts = {
        "elements": analysis.elements.accepted, "rejected": analysis.elements.rejected,
        "graph_nodes": analysis.graph.nodes, "graph_edges": analysis.graph.edges,
        "pruned_nodes": pruned_nodes(analysis.clusters.edges), "pruned_edges": analysis.clusters.edges,
    }
    record = {name: table.count() for name, table in counts.items()}
    kinds = analysis.systems.members.groupBy("kind").agg(F.countDistinct("feature_id").alias("n"))
    found = {row["kind"]: row["n"] for row in kinds.toLocalIterator()}
    record.update(mcs=found.get("MCS", 0), mcc=found.get("MCC", 0))
    record["seconds"] = {name: round(value, 3) for name, value in timings.items()}
    record["seconds"]["total"] = round(sum(timings.values()), 3)
    return record


class _Clock:
    def __init__(self, timings: dict[str, float] | None) -> None:
        self.timings = timings
        self.last = time.perf_counter()

    def mark(self, name: str) -> None:
        now = time.perf_counter()
        if self.timings is not None:
            self.timings[name] = now - self.last
        self.last = now
