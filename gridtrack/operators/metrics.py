"""Measures of systems.

Input of most functions is ``nodes``: feature members joined with their
elements (``feature_nodes``).  Everything is an aggregation with partial sums,
so a system that holds most elements is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtrack.config import TrackConfig
from gridtrack.functions.dates import average_clock, clock
from gridtrack.functions.geo import ratio_speed
from gridtrack.functions.histogram import histogram
from gridtrack.operators.precip import PRECIP_COLUMNS


def feature_nodes(members: DataFrame, elements: DataFrame, kind: str | None = None) -> DataFrame:
    """Members with their element columns; rain columns are zero when absent."""
    chosen = members if kind is None else members.where(F.col("kind") == kind)
    out = chosen.join(elements.drop("frame", "ce_no", "id"), "node")
    for name in PRECIP_COLUMNS:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(0.0))
    return out


def feature_times(nodes: DataFrame) -> DataFrame:
    """Distinct times of each feature."""
    return nodes.select("kind", "feature_id", "ts").distinct()


def temporal_info(nodes: DataFrame) -> DataFrame:
    """Start, end, time step and duration; the last frame lasts one step.

    The step is the gap between the first two times; a one-frame feature has
    none and a duration of NULL.
    """
    times = feature_times(nodes)
    starts = times.groupBy("kind", "feature_id").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n_times"))
    later = times.join(starts.select("kind", "feature_id", "start"), ["kind", "feature_id"]).where("ts > start")
    second = later.groupBy("kind", "feature_id").agg(F.min("ts").alias("second"))
    step = _seconds("second") - _seconds("start")
    return starts.join(second, ["kind", "feature_id"], "left").select(
        "kind", "feature_id", "start", "end", "n_times", step.alias("step_sec"),
        (_seconds("end") - _seconds("start") + step).alias("duration_sec"))


def _seconds(name: str) -> Column:
    return F.unix_timestamp(F.col(name).cast("timestamp"))


def duration_summary(info: DataFrame) -> DataFrame:
    """Average, longest and shortest duration and number of features, per kind."""
    return info.groupBy("kind").agg(
        F.avg("duration_sec").alias("avg_duration_sec"), F.max("duration_sec").alias("longest_sec"),
        F.min("duration_sec").alias("shortest_sec"), F.count(F.lit(1)).alias("n_features"))


def feature_areas(nodes: DataFrame) -> DataFrame:
    """Mean element area per feature."""
    return nodes.groupBy("kind", "feature_id").agg(F.avg("area").alias("mean_area"))


def average_feature_size(nodes: DataFrame) -> DataFrame:
    """Mean over features of their mean element area."""
    return feature_areas(nodes).groupBy("kind").agg(F.avg("mean_area").alias("avg_size"))


def average_time(df: DataFrame, ts: str, by: list[str]) -> DataFrame:
    """Mean time of day of ``ts``."""
    return df.groupBy(*by).agg(average_clock(ts).alias("avg_sec")).withColumn("avg_clock", clock("avg_sec"))


def common_feature_size(nodes: DataFrame, bins: int = 10) -> DataFrame:
    """Histogram of the mean areas."""
    return histogram(feature_areas(nodes), "mean_area", bins, by=["kind"])


def element_speed(nodes: DataFrame, edges: DataFrame, config: TrackConfig) -> DataFrame:
    """Smallest displacement measure between a member and the members it is linked to, 0 without links."""
    links = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    here = nodes.select("kind", "feature_id", "node", F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"))
    there = nodes.select("kind", "feature_id", F.col("node").alias("dst"),
                         F.col("center_lat").alias("lat2"), F.col("center_lon").alias("lon2"))
    speed = ratio_speed(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), config.lat_distance, config.tres)
    moved = (
        here.join(links.withColumnRenamed("src", "node"), "node")
        .join(there, ["kind", "feature_id", "dst"])
        .groupBy("kind", "feature_id", "node").agg(F.min(speed).alias("speed"))
    )
    return nodes.select("kind", "feature_id", "node", "id").join(
        moved, ["kind", "feature_id", "node"], "left").select(
        "kind", "feature_id", "id", F.coalesce("speed", F.lit(0.0)).alias("speed"))


def precip_max_min(nodes: DataFrame, rain: DataFrame) -> DataFrame:
    """Smallest and largest non-zero rain rate of each member; NULL where it does not rain."""
    rates = rain.groupBy("frame", "ce_no").agg(F.min("rain").alias("min_rate"), F.max("rain").alias("max_rate"))
    return nodes.select("kind", "feature_id", "id", "frame", "ce_no").join(
        rates, ["frame", "ce_no"], "left").select("kind", "feature_id", "id", "min_rate", "max_rate")


def precip_totals(nodes: DataFrame) -> DataFrame:
    """Rain per run of equal hours, in time order, and the total as the last row (hour NULL).

    Members are summed per frame first; the run detection then sees one row per
    frame of a feature.
    """
    per_frame = nodes.groupBy("kind", "feature_id", "frame").agg(
        F.hour(F.min("ts")).alias("hour"), F.sum("precip_total").alias("rain"))
    in_time = Window.partitionBy("kind", "feature_id").orderBy("frame")
    turn = F.coalesce((F.col("hour") != F.lag("hour").over(in_time)).cast("int"), F.lit(1))
    runs = (
        per_frame.withColumn("turn", turn)
        .withColumn("run", F.sum("turn").over(in_time.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        .groupBy("kind", "feature_id", "run").agg(F.first("hour").alias("hour"), F.sum("rain").alias("rain"))
    )
    totals = runs.groupBy("kind", "feature_id").agg(
        (F.max("run") + 1).alias("run"), F.lit(None).cast("int").alias("hour"), F.sum("rain").alias("rain"))
    return runs.unionByName(totals)


def _mature(column: str) -> Column:
    """Members the stage averages cover: mature ones of a complex, all of a system."""
    return F.when((F.col("kind") == "MCS") | (F.col("stage") == "M"), F.col(column))


def _rated(column: str) -> Column:
    """As ``_mature``, with unlabelled members of a complex counted too."""
    return F.when((F.col("kind") == "MCS") | (F.col("stage") == "M") | F.col("stage").isNull(), F.col(column))


def feature_report(nodes: DataFrame, config: TrackConfig) -> DataFrame:
    """The published per-feature values, one row per feature.

    Every value counts each member once; propagation speed is reported as 0, as
    published.
    """
    first_largest = F.struct("area", -F.col("seq"))
    rains = F.when(F.col("precip_total") > 0, F.col("precip_total"))
    zero = F.lit(0.0)
    return nodes.groupBy("kind", "feature_id").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"),
        F.min_by("ts", "seq").alias("maturity"),
        (F.count(_mature("area")) * F.lit(config.tres)).alias("mature_hours"),
        F.coalesce(F.avg(_mature("area")), zero).alias("avg_area"),
        F.max("area").alias("max_area"), F.max_by("ts", first_largest).alias("max_area_ts"),
        F.max_by("eccentricity", first_largest).alias("max_area_eccentricity"),
        F.max_by("center_lat", first_largest).alias("max_area_lat"),
        F.max_by("center_lon", first_largest).alias("max_area_lon"),
        zero.alias("speed"),
        F.min("precip_min").alias("min_rate"), F.max("precip_max").alias("max_rate"),
        F.coalesce(F.sum(rains), zero).alias("precip_total"),
        F.coalesce(F.avg(rains), zero).alias("avg_precip"),
        F.coalesce(F.avg(_rated("precip_max")), zero).alias("avg_max_rate"),
        F.coalesce(F.avg(_rated("precip_min")), zero).alias("avg_min_rate"),
        F.avg("precip_area").alias("avg_precip_area"),
        (F.avg(F.col("precip_area") / F.col("area")) * 100).alias("precip_area_pct"),
    ).withColumn("duration_hours", (_seconds("end") - _seconds("start")) / 3600 + F.lit(config.tres))


def summary_report(nodes: DataFrame, config: TrackConfig) -> DataFrame:
    """The published summary values, one row per kind."""
    report = feature_report(nodes, config)
    zero = F.lit(0.0)
    per_feature = report.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_features"), F.avg("duration_hours").alias("avg_duration_hours"),
        average_clock("start").alias("start_sec"), average_clock("end").alias("end_sec"),
        F.avg("avg_area").alias("avg_size"), F.avg("max_area").alias("avg_max_size"),
        F.coalesce(F.avg(F.when(F.col("precip_total") > 0, F.col("avg_precip"))), zero).alias("avg_precip"),
        F.coalesce(F.avg(F.when(F.col("precip_total") > 0, F.col("precip_total"))), zero).alias("avg_total_precip"),
    )
    per_member = nodes.groupBy("kind").agg(
        F.avg("precip_area").alias("avg_precip_area"),
        F.coalesce(F.avg(_mature("precip_min")), zero).alias("avg_min_rate"),
        F.coalesce(F.avg(_mature("precip_max")), zero).alias("avg_max_rate"),
        (F.avg(F.col("precip_area") / F.col("area")) * 100).alias("precip_area_pct"),
    )
    return per_feature.join(per_member, "kind").select(
        "kind", "n_features", "avg_duration_hours", clock("start_sec").alias("avg_start"),
        clock("end_sec").alias("avg_end"), "avg_size", "avg_precip_area", "avg_max_size",
        zero.alias("avg_speed"), zero.alias("max_speed"), zero.alias("min_speed"),
        "avg_min_rate", "avg_max_rate", "avg_precip", "avg_total_precip", "precip_area_pct")
