"""The data behind each published figure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrack.functions.geo import size_class
from gridtrack.functions.histogram import histogram
from gridtrack.operators.metrics import temporal_info
from gridtrack.operators.scans import running_sum


def edge_classes(edges: DataFrame) -> DataFrame:
    """Number of links per weight class."""
    return edges.groupBy("weight").agg(F.count(F.lit(1)).alias("n_edges"))


def size_points(nodes: DataFrame) -> DataFrame:
    """Area of each member over time with its marker class."""
    return nodes.select("kind", "feature_id", "id", "ts", "area", size_class("area").alias("size_class"))


def size_limits(nodes: DataFrame) -> DataFrame:
    """Axis limits of the area figure, per feature: one step around the life time."""
    areas = nodes.groupBy("kind", "feature_id").agg(
        F.min("area").alias("min_area"), (F.max("area") + 1000).alias("max_area"))
    step = F.make_dt_interval(secs=F.col("step_sec").cast("decimal(18,6)"))
    return temporal_info(nodes).join(areas, ["kind", "feature_id"]).select(
        "kind", "feature_id", (F.col("start") - step).alias("from_ts"), (F.col("end") + step).alias("to_ts"),
        "min_area", "max_area")


def precip_points(nodes: DataFrame) -> DataFrame:
    """Centre, share of the feature's area as marker size, and rain coverage of each member."""
    totals = nodes.groupBy("kind", "feature_id").agg(F.sum("area").alias("feature_area"))
    coverage = F.col("precip_area") / F.col("area") * 100
    return nodes.join(totals, ["kind", "feature_id"]).select(
        "kind", "feature_id", "id", "ts", "center_lat", "center_lon",
        (F.col("area") / F.col("feature_area") * 30000).alias("marker"), coverage.alias("coverage_pct"),
        F.when(F.col("area") >= 2400, F.concat(F.floor(coverage).cast("string"), F.lit("%"))).alias("label"))


def rain_in_range(rain: DataFrame, frames: DataFrame, start: str, end: str, step_hours: float) -> DataFrame:
    """Rain per cell summed over the generated times ``start, start + step, ... <= end``."""
    first, last = (F.expr(f"timestamp_ntz'{t.replace('_', ' ')}'") for t in (start, end))
    step = F.expr(f"interval '{int(step_hours * 3600)}' second")
    times = frames.sparkSession.range(1).select(F.explode(F.sequence(first, last, step)).alias("ts"))
    wanted = frames.join(times, "ts", "left_semi").select("frame")
    return (
        rain.where(F.col("rain") >= 0).join(wanted, "frame", "left_semi")
        .groupBy("r", "c").agg(F.sum("rain").alias("rain"))
    )


def running_rain(rain: DataFrame, block: int = 256) -> DataFrame:
    """``(frame, r, c, rain, running)``: rain of every cell and frame, and its sum since the first frame."""
    cells = rain.where(F.col("rain") >= 0).groupBy("frame", "r", "c").agg(F.sum("rain").alias("rain"))
    return running_sum(cells, ["r", "c"], "frame", "rain", block)


def rain_per_feature(nodes: DataFrame, rain: DataFrame) -> DataFrame:
    """Rain per cell summed over the members of each feature."""
    return (
        rain.where(F.col("rain") >= 0)
        .join(nodes.select("kind", "feature_id", "frame", "ce_no"), ["frame", "ce_no"])
        .groupBy("kind", "feature_id", "r", "c").agg(F.sum("rain").alias("rain"))
    )


def element_rain_histogram(nodes: DataFrame, rain: DataFrame, bins: int = 5) -> DataFrame:
    """Histogram of the non-zero rain rates of each member."""
    rates = rain.join(nodes.select("frame", "ce_no", "id").distinct(), ["frame", "ce_no"])
    return histogram(rates.where(F.col("rain") != 0), "rain", bins, by=["id"])


def feature_rain_histogram(nodes: DataFrame, rain: DataFrame, bins: int = 10) -> DataFrame:
    """Histogram of the non-zero cells of each feature's summed rain."""
    summed = rain_per_feature(nodes, rain).where(F.col("rain") != 0)
    return histogram(summed, "rain", bins, by=["kind", "feature_id"])


def masked_frames(pixels: DataFrame, levels: list[int]) -> DataFrame:
    """Cloudy pixels per frame below each display level."""
    steps = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: F.col("tb") < x)
    return (
        pixels.select("frame", F.explode(steps).alias("level"))
        .groupBy("frame", "level").agg(F.count(F.lit(1)).alias("n_px"))
    )


def frame_composite(pixels: DataFrame) -> DataFrame:
    """One grid per frame from the grids of its elements: the coldest value of each cell."""
    return pixels.groupBy("frame", "r", "c").agg(F.min("tb").alias("tb"))
