"""Parquet products: element grids, rain grids, systems and differences.

Elements and tracked nodes are stored tables, as later runs bring values into
them: rain that is attached afterwards, behaviours and stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtrack.config import TrackConfig
from gridtrack.operators import compare, metrics, plot_data
from gridtrack.operators.paths import behaviours, root_paths
from gridtrack.operators.precip import PRECIP_COLUMNS, attach_rain
from gridtrack.operators.raster import Raster
from gridtrack.plans.pipeline import Analysis, run_record
from gridtrack.session import stage
from gridtrack.sinks import netcdf, stored, text

#: 64 frames make a part of a stored table
ELEMENT_KEYS, ELEMENT_PARTS = ["frame", "ce_no"], "frame div 64"
NODE_KEYS, NODE_PARTS = ["node"], "node div 274877906944"


def located(cells: DataFrame, raster: Raster) -> DataFrame:
    """Cells with time and coordinates."""
    return cells.join(raster.frames, "frame").join(raster.rows, "r").join(raster.cols, "c")


def write_by_day(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per day, so a period is read without listing every frame."""
    table.withColumn("day", F.to_date("ts")).write.mode(mode).partitionBy("day").parquet(path)


def dense_grid(cells: DataFrame, value: str, raster: Raster) -> DataFrame:
    """Full-domain view of sparse cells: 0 where there is none, per element."""
    lines = [axis.agg(F.min(x), F.max(x)).first() for axis, x in ((raster.rows, "r"), (raster.cols, "c"))]
    every = (
        cells.select("frame", "ce_no").distinct()
        .withColumn("r", F.explode(F.sequence(*map(F.lit, lines[0]))))
        .withColumn("c", F.explode(F.sequence(*map(F.lit, lines[1]))))
    )
    return every.join(cells.select("frame", "ce_no", "r", "c", value), ["frame", "ce_no", "r", "c"], "left").fillna(
        0, [value])


def store_rain(path: str, rain: DataFrame, config: TrackConfig) -> DataFrame:
    """Bring the rain of cells into stored elements; values that are known stay, elements without rain get zeros."""
    spark = rain.sparkSession
    wet = attach_rain(stored.read(spark, path).select(*ELEMENT_KEYS), rain, config)
    stored.upsert(path, wet.select(*ELEMENT_KEYS, *PRECIP_COLUMNS), stored.SET_ONCE, insert=False)
    return stored.read(spark, path)


def store_nodes(path: str, updates: DataFrame, overwrite: bool = False) -> DataFrame:
    """Bring ``updates(node, ...)`` of behaviours, stages or others into stored nodes: set once, replaced on request."""
    stored.upsert(path, updates, stored.OVERWRITE if overwrite else stored.SET_ONCE)
    return stored.read(updates.sparkSession, path)


def write_accumulations(nodes: DataFrame, rain: DataFrame, raster: Raster, config: TrackConfig, root: str) -> None:
    """Rain summed over the configured period per cell, and per feature and cell."""
    period = plot_data.rain_in_range(rain, raster.frames, str(config.start_time), str(config.end_time), config.tres)
    period.write.mode("overwrite").parquet(f"{root}/rain_total")
    plot_data.rain_per_feature(nodes, rain).write.mode("overwrite").parquet(f"{root}/rain_per_feature")


def write_differences(spark: SparkSession, left: str, right: str, path: str) -> None:
    """Compare two stored runs: cells of elements, elements, and tracked nodes that only one has.

    Tables ``cells``, ``elements`` and ``nodes`` are written below ``path``, with the log of the comparison.
    """
    pixels = [spark.read.parquet(f"{x}/element_grids").select("frame", "ce_no", "r", "c", "tb") for x in (left, right)]
    digests = tuple(spark.read.parquet(f"{x}/digests") for x in (left, right))
    cells = stage(compare.compare_elements(*pixels, digests=digests), "differences")
    cells.where("n_different > 0").write.mode("overwrite").parquet(f"{path}/cells")
    elements = stage(compare.only_in_one(*[stored.read(spark, f"{x}/elements") for x in (left, right)], ELEMENT_KEYS), "differences")
    elements.write.mode("overwrite").parquet(f"{path}/elements")
    nodes = stage(compare.only_in_one(*[stored.read(spark, f"{x}/nodes") for x in (left, right)], NODE_KEYS), "differences")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    text.write_lines(text.difference_log(left, right, cells, elements, nodes), f"{path}/log")


def write_netcdf(analysis: Analysis, config: TrackConfig) -> None:
    """The grids of elements, of their rain, and of accumulated rain as netCDF files."""
    root, raster = text.report_folder(config), analysis.raster
    # fixed values: folders, names and variables of the published products
    netcdf.write_grids(netcdf.element_grids(analysis.elements.pixels, "tb", raster, "cloudElements"), raster,
                       f"{root}/MERGnetcdfCEs", "brightnesstemp", "Kelvin", "Cloud Element temperature data")
    if analysis.rain is None:
        return
    folder, rain = f"{root}/TRMMnetcdfCEs", ("precipitation_Accumulation", "mm")
    netcdf.write_grids(netcdf.element_grids(analysis.rain, "rain", raster, "TRMM"), raster, folder, *rain, "Cloud Element precipitation data")
    first, last = str(config.start_time), str(config.end_time)
    begins = F.lit(first).cast("timestamp_ntz")
    period = plot_data.rain_in_range(analysis.rain, raster.frames, first, last, config.tres)
    name = F.lit(f"accu{first}-{last}.nc".replace(" ", "_"))
    netcdf.write_grids(netcdf.summed_grid(period, name, begins), raster, folder, *rain, "Accumulated precipitation data", "append")
    nodes = analysis.nodes()
    starts = nodes.groupBy("kind", "feature_id").agg(F.min("ts").alias("begins"))
    features = plot_data.rain_per_feature(nodes, analysis.rain).join(starts, ["kind", "feature_id"])
    name = F.concat(F.lit("accu"), "kind", F.col("feature_id").cast("string"), F.lit(".nc"))
    netcdf.write_grids(netcdf.summed_grid(features, name, F.col("begins")), raster, folder, *rain, "Accumulated precipitation data per feature", "append")


def write_products(analysis: Analysis, config: TrackConfig, timings: dict[str, float] | None = None,
                   bad_files: DataFrame | None = None) -> None:
    """All tables and reports of a run below ``config.output_dir``."""
    root = text.report_folder(config)
    raster, found = analysis.raster, analysis.elements
    write_by_day(located(found.pixels, raster), f"{root}/element_grids")
    stored.create(found.accepted, f"{root}/elements", ELEMENT_KEYS, ELEMENT_PARTS)
    compare.leaf_digests(found.pixels).write.mode("overwrite").parquet(f"{root}/digests")
    named = behaviours(analysis.clusters.edges).select("node", "behaviour").join(analysis.systems.stages, "node", "left")
    stored.create(named, f"{root}/nodes", NODE_KEYS, NODE_PARTS)
    analysis.graph.edges.write.mode("overwrite").parquet(f"{root}/edges")
    analysis.clusters.edges.write.mode("overwrite").parquet(f"{root}/pruned_edges")
    analysis.systems.members.write.mode("overwrite").partitionBy("kind").parquet(f"{root}/feature_members")
    if analysis.rain is not None:
        write_by_day(located(analysis.rain, raster), f"{root}/rain_grids")
        write_accumulations(analysis.nodes(), analysis.rain, raster, config, root)
    if config.netcdf_products:
        write_netcdf(analysis, config)
    nodes = analysis.nodes()
    reports = {
        "elements": text.accepted_elements(found.accepted),
        "rejected": text.rejected_elements(found.rejected),
        "graph_json": text.graph_json(found.accepted, analysis.graph.edges),
        "cluster_paths": text.cluster_paths(root_paths(analysis.graph.edges, config), analysis.clusters.roots),
        "feature_lists": text.feature_lists(analysis.systems.members),
        "features": text.feature_blocks(metrics.feature_report(nodes, config)),
        "summary": text.summary_block(metrics.summary_report(nodes, config)),
    }
    for name, lines in reports.items():
        text.write_lines(lines, f"{root}/reports/{name}")
    if timings is not None:
        record = run_record(analysis, timings)
        if bad_files is not None:
            bad_files.coalesce(1).write.mode("overwrite").parquet(f"{root}/bad_files")
            record["bad_files"] = {r["kind"]: r["n"] for r in bad_files.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        text.write_run_record(raster.frames.sparkSession, record, f"{root}/run.json")
