"""Published text and JSON reports as line tables, and their writers.

Every function returns a DataFrame of text lines in report order;
``write_lines`` stores it.  Links, path steps and members have a line each,
however many belong together.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtrack.config import TrackConfig
from gridtrack.operators.elements import node_frame, node_number


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the ``line`` column, ordered by the other columns."""
    keys = [x for x in lines.columns if x != "line"]
    lines.orderBy(*keys).select("line").write.mode(mode).text(path)


def _text(ts: str) -> Column:
    return F.date_format(F.col(ts), "yyyy-MM-dd HH:mm:ss")


def _block(*lines: Column) -> Column:
    return F.concat_ws("\n", *lines)


def _num(label: str, column: str, unit: str = "") -> Column:
    return F.format_string(f"{label}: %.4f{unit}", F.col(column).cast("double"))


def accepted_elements(elements: DataFrame) -> DataFrame:
    """One block per accepted element."""
    return elements.select("frame", "ce_no", _block(
        F.concat(F.lit("Time is: "), _text("ts")),
        F.concat(F.lit("ceUniqueID is: "), F.col("id")),
        F.format_string("Center (lat,lon) is: [%s, %s]", F.col("center_lat"), F.col("center_lon")),
        _num("Area is", "area", " km^2"),
        _num("Average brightness temperature is", "bt_avg"),
        _num("Min brightness temperature is", "tmin", " K"),
        _num("Max brightness temperature is", "tmax", " K"),
        _num("Brightness temperature variance is", "bt_var", " K"),
        _num("Convective fraction is", "cf"), _num("Eccentricity is", "eccentricity"),
    ).alias("line"))


def rejected_elements(rejected: DataFrame) -> DataFrame:
    """One block per rejected region, numbered 0 in its frame."""
    return rejected.select("frame", "label", _block(
        F.concat(F.lit("Time is: "), _text("ts")),
        F.format_string("ceUniqueID is: F%dCE0", F.col("frame")),
        F.format_string("Center (lat,lon) is: %.2f\t%.2f", F.col("center_lat"), F.col("center_lon")),
        F.format_string("Number of boxes are: %d", F.col("n_px")),
        _num("Area is", "area", " km^2"),
        _num("Average brightness temperature is", "bt_avg", " K"),
        _num("Min brightness temperature is", "tmin", " K"),
        _num("Max brightness temperature is", "tmax", " K"),
        _num("Brightness temperature variance is", "bt_var", " K"),
        _num("Convective fraction is", "cf"), _num("Eccentricity is", "eccentricity"),
    ).alias("line"))


def graph_json(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """A JSON object per link: the later element and, in ``edges``, the parent of this link.

    An element with several parents has as many objects, in the order of its
    parents; no group of links is gathered, however many an element has.
    """
    parent = F.concat(F.lit("F"), node_frame("src").cast("string"), F.lit("CE"), node_number("src").cast("string"))
    record = F.struct(
        F.col("id").alias("cloudElement"), _text("ts").alias("time"), "area",
        F.col("tmax").alias("Tmax"), F.col("tmin").alias("Tmin"),
        F.array("center_lat", "center_lon").alias("center"), F.col("eccentricity").alias("shape"),
        F.array("min_lon", "min_lat", "max_lon", "max_lat").alias("cloudElementLatLonBox"),
        F.col("cf").alias("convective_fraction"), F.array(parent).alias("edges"))
    return elements.join(edges.select(F.col("dst").alias("node"), "src"), "node").select(
        "frame", "ce_no", "src", F.to_json(record).alias("line"))


def cluster_paths(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """A line per step of every root's path: the path distance, the step and its element."""
    return paths.join(roots.select("root", "distance"), "root").select("root", "step", F.format_string(
        "Subtree pathlength is %d and step %d of F%dCE%d is F%dCE%d", F.col("distance"), F.col("step"),
        node_frame("root"), node_number("root"), node_frame("node"), node_number("node")).alias("line"))


def feature_lists(members: DataFrame) -> DataFrame:
    """A line per member of each feature, in member order."""
    return members.select("kind", "feature_id", "seq", F.format_string(
        "%s %d member %d is %s", F.col("kind"), F.col("feature_id"), F.col("seq"), F.col("id")).alias("line"))


def feature_blocks(report: DataFrame) -> DataFrame:
    """The 19-line block of each feature."""
    hours = F.format_string("Life duration is %.2f hrs", F.col("duration_hours"))
    return report.select("kind", "feature_id", _block(
        F.concat(F.lit("Starttime is: "), _text("start")), F.concat(F.lit("Endtime is: "), _text("end")), hours,
        F.concat(F.lit("Time of maturity is "), _text("maturity")),
        F.format_string("Duration mature stage is: %s", F.col("mature_hours")),
        _num("Average area is", "avg_area", " km^2"), _num("Max area is", "max_area", " km^2"),
        F.concat(F.lit("Max area time is: "), _text("max_area_ts")),
        _num("Eccentricity at max area is", "max_area_eccentricity"),
        F.format_string("Center (lat,lon) at max area is: %.2f\t%.2f", F.col("max_area_lat"), F.col("max_area_lon")),
        _num("Propagation speed is", "speed"),
        _num("MCS minimum precip rate is", "min_rate", " mmh^-1"),
        _num("MCS maximum precip rate is", "max_rate", " mmh^-1"),
        _num("Total precipitation during MCS is", "precip_total", " mm/lifetime"),
        _num("Average MCS precipitation is", "avg_precip", " mm"),
        _num("Average MCS maximum precipitation is", "avg_max_rate", " mmh^-1"),
        _num("Average MCS minimum precipitation is", "avg_min_rate", " mmh^-1"),
        _num("Average precipitation area is", "avg_precip_area", " km^2"),
        _num("Precipitation area percentage of mature system", "precip_area_pct", " percent"),
    ).alias("line"))


def summary_block(summary: DataFrame) -> DataFrame:
    """The 15-line summary of each kind."""
    return summary.select("kind", _block(
        F.format_string("Number of features is %d", F.col("n_features")),
        _num("Average duration is", "avg_duration_hours", " hrs"),
        F.concat(F.lit("Average startTime is "), F.col("avg_start")),
        F.concat(F.lit("Average endTime is "), F.col("avg_end")),
        _num("Average size is", "avg_size", " km^2"),
        _num("Average precipitation area is", "avg_precip_area", " km^2"),
        _num("Average maximum size is", "avg_max_size", " km^2"),
        _num("Average propagation speed is", "avg_speed", " ms^-1"),
        _num("Maximum propagation speed is", "max_speed", " ms^-1"),
        _num("Minimum propagation speed is", "min_speed", " ms^-1"),
        _num("Average minimum precipitation rate is", "avg_min_rate", " mmh^-1"),
        _num("Average maximum precipitation rate is", "avg_max_rate", " mm h^-1"),
        _num("Average precipitation is", "avg_precip", " mm"),
        _num("Average total precipitation during MCSs is", "avg_total_precip", " mm/LD"),
        _num("Average precipitation area percentage is", "precip_area_pct", " percent"),
    ).alias("line"))


def difference_log(left: str, right: str, cells: DataFrame, elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """A line per element that differs or that one run lacks, and per tracked node that one run lacks."""
    spark = cells.sparkSession
    # fixed values: the opening lines of the published log
    head = spark.createDataFrame([(0, f"baselinePath1 is {left}"), (1, f"baselinePath2 is {right}")], "place int, line string")
    name = F.concat(F.lit("F"), F.col("frame").cast("string"), F.lit("CE"), F.col("ce_no").cast("string"))
    lines = [
        elements.select(F.lit(2).alias("place"), F.concat(name, F.lit(" is only in the "), "only_in", F.lit(" run")).alias("line")),
        cells.select(F.lit(3).alias("place"), F.when(F.col("n_different") == 0, F.concat(name, F.lit(" is equal"))).otherwise(F.format_string(
            "%s is NOT equal: %d cells differ, by %d at most", name, "n_different", "max_difference")).alias("line")),
        nodes.select(F.lit(4).alias("place"), F.concat(F.lit("node "), F.col("node").cast("string"), F.lit(" is tracked in the "), "only_in", F.lit(" run only")).alias("line")),
    ]
    for more in lines:
        head = head.unionByName(more)
    return head.select("place", F.col("line").alias("text"), "line")


def write_run_record(spark: SparkSession, record: dict, path: str) -> None:
    """Store the run's counts and stage seconds as one JSON object, on whatever file system ``path`` names."""
    line = spark.range(1).select(F.lit(json.dumps(record, sort_keys=True)).alias("value"))
    line.coalesce(1).write.mode("overwrite").text(path)


def report_folder(config: TrackConfig) -> str:
    if config.output_dir is None:
        raise ValueError("output_dir is not configured")
    return config.output_dir.rstrip("/")
