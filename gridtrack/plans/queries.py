"""The registered queries: every operator run over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtrack.functions import dates
from gridtrack.functions.geo import eccentricity, normalize_longitude
from gridtrack.functions.histogram import histogram
from gridtrack.operators import asof, chains, compare, elements, labeling, links, metrics, paths, plot_data, precip
from gridtrack.operators import raster as rasters
from gridtrack.operators import regrid, systems
from gridtrack.plans import driver_tables as data
from gridtrack.plans import pipeline
from gridtrack.session import scratch_path, stage
from gridtrack.sinks import netcdf, stored, tables
from gridtrack.sources import files, gridfiles

CONFIG = data.CONFIG
COMPONENT = CONFIG.with_options(element_mode="component")
STRICT = CONFIG.with_options(area_min=160, convective_fraction=0.92)
CLIP = CONFIG.with_options(lat_min=5.6, lat_max=8.1, lon_min=-4.3, lon_max=-2.1)


def r6(column: str | Column, name: str | None = None) -> Column:
    """Doubles rounded for comparison across engines."""
    if isinstance(column, str):
        return F.round(F.col(column), 6).alias(name or column)
    return F.round(column, 6).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- shared prefixes of the pipeline ---------------------------------------------------------

def _stats(spark, sf_dir, config=CONFIG):
    raster = data.raster(spark, sf_dir, config)
    boxes = elements.element_boxes(raster, config)
    return elements.with_coordinates(elements.element_stats(raster, boxes, config), raster)


def _elements(spark, sf_dir, config=CONFIG):
    raster = data.raster(spark, sf_dir, config)
    return raster, pipeline.elements_with_pixels(raster, config)


def _wet_elements(spark, sf_dir):
    raster, found = _elements(spark, sf_dir)
    wet, rain = pipeline.with_rain(found, data.rain_source(spark, sf_dir), raster, CONFIG)
    return raster, wet, rain


def _graph(spark, sf_dir):
    raster, found = _elements(spark, sf_dir)
    return raster, found, links.build_graph(found.accepted, found.pixels, CONFIG, raster)


def _clusters(spark, sf_dir, config=CONFIG):
    return paths.prune(_graph(spark, sf_dir)[2].edges, config)


def _analysis(spark, sf_dir, rain=False):
    source = data.rain_source(spark, sf_dir) if rain else None
    return pipeline.analyse(data.raster(spark, sf_dir), CONFIG, source)


def _systems_only(spark, sf_dir, rain=False):
    """Members of all systems without stages: enough for measures that ignore them."""
    if rain:
        raster, found, wet = _wet_elements(spark, sf_dir)
    else:
        raster, found = _elements(spark, sf_dir)
        wet = None
    graph = links.build_graph(found.accepted, found.pixels, CONFIG, raster)
    clusters = paths.prune(graph.edges, CONFIG)
    members = systems.system_members(clusters.edges, CONFIG).select(
        "node", F.col("component").alias("feature_id"), F.lit("MCS").alias("kind"),
        F.lit(None).cast("string").alias("stage"),
        elements.node_frame("node").alias("frame"), elements.node_number("node").alias("ce_no"),
    ).withColumn("id", elements.element_id("frame", "ce_no"))
    members = systems.number_rows(members, "feature_id", "frame", ["ce_no"], "seq")
    return metrics.feature_nodes(members, found.accepted), clusters, wet, raster


# --- grid ------------------------------------------------------------------------------------

def grid_raster(spark, sf_dir):
    return data.grid(spark, sf_dir).select("frame", "ts", "r", "c", "lat", "lon", "tb")


def mask_threshold(spark, sf_dir):
    return data.raster(spark, sf_dir).pixels


def clip_domain(spark, sf_dir):
    return rasters.raster_from_grid(data.grid(spark, sf_dir), CLIP).pixels


def nearest_axis(spark, sf_dir):
    raster = data.raster(spark, sf_dir)
    lat = rasters.nearest_on_axis(raster.rows, "r", "lat", 6.1).select(F.lit("lat").alias("axis"), F.col("r").alias("line"), F.col("lat").alias("value"))
    lon = rasters.nearest_on_axis(raster.cols, "c", "lon", -3.875).select(F.lit("lon").alias("axis"), F.col("c").alias("line"), F.col("lon").alias("value"))
    return lat.unionByName(lon)


def time_filter(spark, sf_dir):
    config = CONFIG.with_options(start="2024010500", end="202401120000")
    return rasters.between_times(data.grid(spark, sf_dir), config).groupBy("frame").agg(F.count(F.lit(1)).alias("n_cells"))


def lon_normalize(spark, sf_dir):
    lon = (F.col("c_custkey") % 721) / 2
    return table(spark, sf_dir, "customer").select("c_custkey", normalize_longitude(lon).alias("lon"))


# --- regions and elements -----------------------------------------------------------------------

def label_components(spark, sf_dir):
    labelled = labeling.label_pixels(elements.scoped(data.raster(spark, sf_dir).pixels), CONFIG.tile)
    return labelled.select(F.col("scope").cast("int").alias("frame"), "r", "c", "tb", "label")


def label_components_tiled(spark, sf_dir):
    """The same labels from tiles of 4 x 4 cells, merged along their seams."""
    labelled = labeling.label_pixels(elements.scoped(data.raster(spark, sf_dir).pixels), 4)
    return labelled.select(F.col("scope").cast("int").alias("frame"), "r", "c", "tb", "label")


def element_bbox(spark, sf_dir):
    boxes = elements.element_boxes(data.raster(spark, sf_dir), CONFIG)
    return boxes.select("frame", "label", "r0", "r1", "c0", "c1", F.col("n").alias("region_px"))


def element_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select(
        "frame", "label", "n_px", "area", "tmin", "tmax", r6("bt_avg"), r6("bt_var"), r6("cf"))


def element_stats_component(spark, sf_dir):
    return _stats(spark, sf_dir, COMPONENT).select(
        "frame", "label", "n_px", "area", "tmin", "tmax", r6("bt_avg"), r6("bt_var"), r6("cf"))


def element_shape(spark, sf_dir):
    boxes = elements.element_boxes(data.raster(spark, sf_dir), CONFIG)
    height, width = F.expr("r1 - r0 + 1"), F.expr("c1 - c0 + 1")
    return boxes.select("frame", "label", height.alias("height"), width.alias("width"),
                        r6(eccentricity(height, width), "eccentricity"))


def element_center(spark, sf_dir):
    return _stats(spark, sf_dir).select(
        "frame", "label", "ts", "center_r", "center_c", "center_lat", "center_lon",
        "min_lat", "max_lat", "min_lon", "max_lon")


def element_accept(spark, sf_dir):
    return _stats(spark, sf_dir).select("frame", "label", "accepted")


def element_ids(spark, sf_dir):
    return elements.find_elements(data.raster(spark, sf_dir), CONFIG).accepted.select(
        "frame", "ce_no", "id", "label", "n_px", "area")


def element_reject(spark, sf_dir):
    return elements.find_elements(data.raster(spark, sf_dir), CONFIG).rejected.select(
        "frame", "ts", "label", "n_px", "area", r6("bt_avg"), "tmin", "tmax", r6("bt_var"), r6("cf"), r6("eccentricity"))


def element_pixels(spark, sf_dir):
    return _elements(spark, sf_dir)[1].pixels


def netcdf_round_trip(spark, sf_dir):
    """Pixels of all elements, written as one netCDF grid each and read back."""
    raster, found = _elements(spark, sf_dir)
    path = scratch_path(spark, "element-grids")
    netcdf.write_grids(netcdf.element_grids(found.pixels, "tb", raster, "cloudElements"), raster, path, "brightnesstemp", "Kelvin", "temperatures", gathered=True)
    with gridfiles.pushing(spark):
        cells = gridfiles.open_files(spark, path, variable="brightnesstemp", fold=CONFIG.fold_longitudes).where("kind = 'cell' AND value > 0")
        name = dates.parse_element_file(F.element_at(F.split("file", "/"), -1))
        return stage(cells.select(name.alias("p"), "ts", "r", "c", "lat", "lon", F.col("value").alias("tb")).select(
            "p.frame", "p.ce_no", "ts", "r", "c", "lat", "lon", "tb"), "element-grids-read")


def element_pixel_list(spark, sf_dir):
    raster, found = _elements(spark, sf_dir)
    return elements.pixel_list(found.pixels, raster)


# --- links ------------------------------------------------------------------------------------------

def overlap_pairs(spark, sf_dir):
    raster, found = _elements(spark, sf_dir)
    pairs = links.overlap_pairs(found.accepted, found.pixels, CONFIG)
    return links.readable_edges(pairs).withColumn("pct", r6("pct"))


def edges_weighted(spark, sf_dir):
    return links.readable_edges(_graph(spark, sf_dir)[2].edges).withColumn("pct", r6("pct"))


def isolated_removed(spark, sf_dir):
    return _graph(spark, sf_dir)[2].nodes.select("frame", "ce_no", "id")


def frame_counts(spark, sf_dir):
    raster, found, graph = _graph(spark, sf_dir)
    return links.frame_counts(found.accepted, graph.edges, raster.frames)


def graph_json(spark, sf_dir):
    raster, found, graph = _graph(spark, sf_dir)
    return links.graph_rows(found.accepted, graph.edges).select(
        "id", "ts", "area", "tmax", "tmin", "center_lat", "center_lon", r6("eccentricity"), r6("cf"), "edge")


def edge_classes(spark, sf_dir):
    return plot_data.edge_classes(_graph(spark, sf_dir)[2].edges)


def contiguous_links(spark, sf_dir):
    """Links when frames must be one time step apart; steps here are days."""
    config = CONFIG.with_options(tres=24, require_contiguous_time=True)
    raster, found = _elements(spark, sf_dir)
    return links.readable_edges(links.build_graph(found.accepted, found.pixels, config, raster).edges).select(
        "src_frame", "src_no", "dst_frame", "dst_no", "weight")


# --- pruning and systems --------------------------------------------------------------------------------

def path_depth(spark, sf_dir):
    return _clusters(spark, sf_dir).roots


def path_depth_min_distance(spark, sf_dir):
    return _clusters(spark, sf_dir, CONFIG.with_options(path_rule="min_distance")).roots


def root_path_list(spark, sf_dir):
    """Every element on the chosen path of every root."""
    return paths.root_paths(_graph(spark, sf_dir)[2].edges, CONFIG)


def pruned_edges(spark, sf_dir):
    return links.readable_edges(_clusters(spark, sf_dir).edges)


def components(spark, sf_dir):
    return paths.graph_components(_clusters(spark, sf_dir).edges)


def merge_split(spark, sf_dir):
    return paths.behaviours(_clusters(spark, sf_dir).edges)


def ancestors_chain(spark, sf_dir):
    return chains.chain_ends(_clusters(spark, sf_dir).edges, chains.UP)


def descendants_chain(spark, sf_dir):
    edges = _clusters(spark, sf_dir).edges
    return chains.chain_members(edges, paths.pruned_nodes(edges), chains.DOWN)


def criteria_area(spark, sf_dir):
    raster, found = _elements(spark, sf_dir)
    return systems.criteria_areas(found.accepted, found.pixels, CONFIG)


def criterion_pixels(spark, sf_dir):
    raster, found = _elements(spark, sf_dir)
    return systems.criterion_b_pixels(found.accepted, found.pixels, CONFIG)


def mcs_members(spark, sf_dir):
    nodes, clusters, _, _ = _systems_only(spark, sf_dir)
    return nodes.join(paths.behaviours(clusters.edges).select("node", "behaviour"), "node").select(
        "feature_id", "kind", "seq", "frame", "ce_no", "id", "behaviour")


def mcc_members(spark, sf_dir):
    return _analysis(spark, sf_dir).systems.members.where("kind = 'MCC'").select(
        "feature_id", "kind", "seq", "frame", "ce_no", "id", "behaviour", "stage")


def node_stage(spark, sf_dir):
    return _analysis(spark, sf_dir).systems.stages


# --- second dataset ----------------------------------------------------------------------------------------

def asof_bucket(spark, sf_dir):
    orders = table(spark, sf_dir, "events")
    return orders.select("event_id", dates.floor_to_hours("ts").alias("bucket"))


def regrid_feather(spark, sf_dir):
    filled = regrid.feather(regrid.coarse_grid(data.rain_source(spark, sf_dir), CONFIG.fold_longitudes))
    return filled.cells.select("ts", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), r6("value"), "missing")


def regrid_bilinear(spark, sf_dir):
    raster = data.raster(spark, sf_dir)
    out = regrid.regrid_bilinear(regrid.coarse_grid(data.rain_source(spark, sf_dir), CONFIG.fold_longitudes), raster.rows, raster.cols)
    return out.select("ts", "r", "c", r6("value"))


def regrid_cubic(spark, sf_dir):
    raster = data.raster(spark, sf_dir)
    out = regrid.regrid_cubic(regrid.coarse_grid(data.rain_source(spark, sf_dir), CONFIG.fold_longitudes), raster.rows, raster.cols)
    return out.select("ts", "r", "c", r6("value"))


def element_precip(spark, sf_dir):
    raster, wet, rain = _wet_elements(spark, sf_dir)
    return wet.accepted.select("id", r6("precip_total"), "precip_area", r6("precip_max"), r6("precip_min"))


def precip_late_attach(spark, sf_dir):
    """Elements that already carry a total keep it; the rest is attached afterwards."""
    raster, found = _elements(spark, sf_dir)
    rain = precip.element_rain(found.pixels, data.rain_source(spark, sf_dir), raster, fold=CONFIG.fold_longitudes)
    known = found.accepted.withColumn("precip_total", F.when(F.col("frame") % 2 == 0, F.lit(-1.0)))
    wet = precip.attach_rain(known, rain, CONFIG)
    return wet.select("id", r6("precip_total"), "precip_area", r6("precip_max"), r6("precip_min"))


def stored_rain(spark, sf_dir):
    """Rain brought into stored elements of which some carry a total already."""
    raster, found = _elements(spark, sf_dir)
    rain = precip.element_rain(found.pixels, data.rain_source(spark, sf_dir), raster, fold=CONFIG.fold_longitudes)
    path = scratch_path(spark, "stored-elements")
    known = found.accepted.withColumn("precip_total", F.when(F.col("frame") % 2 == 0, F.lit(-1.0)))
    stored.create(known, path, tables.ELEMENT_KEYS, tables.ELEMENT_PARTS)
    wet = tables.store_rain(path, rain, CONFIG)
    return wet.select("id", r6("precip_total"), "precip_area", r6("precip_max"), r6("precip_min"))


def stored_stages(spark, sf_dir):
    """Stages brought into stored nodes, set once and replaced."""
    nodes = paths.behaviours(_clusters(spark, sf_dir).edges).select("node", "behaviour")
    frame = elements.node_frame("node")
    nodes = stage(nodes.withColumn("stage", F.when(frame % 2 == 0, "I")), "stored-nodes")
    updates = nodes.where(frame % 3 != 1).select("node", F.lit("X").alias("behaviour"), F.when(frame % 3 == 0, "M").alias("stage"))
    states = []
    for mode in (stored.SET_ONCE, stored.OVERWRITE):
        path = scratch_path(spark, "stored-nodes")
        stored.create(nodes.where(frame % 5 != 0), path, tables.NODE_KEYS, tables.NODE_PARTS)
        states.append(tables.store_nodes(path, updates, mode == stored.OVERWRITE).withColumn("mode", F.lit(mode)))
    return states[0].unionByName(states[1])


# --- measures ------------------------------------------------------------------------------------------------

def asof_events(spark, sf_dir):
    """For every event of a user, the purchase that is not more than two days older."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("paid"))
    found = asof.asof_join(events.where("event_type <> 'purchase'").drop("value"), bought, ["user_id"], ["purchase_id", "paid"], 2 * 86400, block=86400)
    return found.select("event_id", "purchase_id", "paid", F.col("right_ts").alias("paid_at"))


def element_precip_asof(spark, sf_dir):
    """Rain of a source with gaps and odd times: every fourth midnight is missing, slices of even days are 37 minutes early."""
    raster, found = _elements(spark, sf_dir)
    config = CONFIG.with_options(rain_tolerance=3.5)
    full = data.rain_source(spark, sf_dir)
    day = F.day("ts")
    source = full.where((F.hour("ts") != 0) | (day % 4 != 0)).withColumn(
        "ts", F.when(day % 2 == 0, F.col("ts") - F.make_dt_interval(mins=F.lit(37))).otherwise(F.col("ts")))
    wet, _ = pipeline.with_rain(found, source, raster, config, full)
    return wet.accepted.select("id", r6("precip_total"), "precip_area", r6("precip_max"), r6("precip_min"))


def feature_duration(spark, sf_dir):
    return metrics.temporal_info(_systems_only(spark, sf_dir)[0])


def duration_summary(spark, sf_dir):
    return metrics.duration_summary(metrics.temporal_info(_systems_only(spark, sf_dir)[0])).withColumn(
        "avg_duration_sec", r6("avg_duration_sec"))


def feature_area(spark, sf_dir):
    return metrics.feature_areas(_systems_only(spark, sf_dir)[0]).withColumn("mean_area", r6("mean_area"))


def average_feature_size(spark, sf_dir):
    return metrics.average_feature_size(_systems_only(spark, sf_dir)[0]).withColumn("avg_size", r6("avg_size"))


def avg_time_of_day(spark, sf_dir):
    return metrics.average_time(table(spark, sf_dir, "events"), "ts", ["event_type"])


def size_histogram(spark, sf_dir):
    return _rounded_bins(metrics.common_feature_size(_systems_only(spark, sf_dir)[0]))


def _rounded_bins(bins: DataFrame) -> DataFrame:
    return bins.withColumn("low", r6("low")).withColumn("high", r6("high")).withColumn("share", r6("share"))


def value_histogram(spark, sf_dir):
    return _rounded_bins(histogram(table(spark, sf_dir, "events"), "value", 10, by=["event_type"]))


def precip_islands(spark, sf_dir):
    nodes, _, _, _ = _systems_only(spark, sf_dir, rain=True)
    return metrics.precip_totals(nodes).withColumn("rain", r6("rain"))


def precip_minmax(spark, sf_dir):
    nodes, _, rain, _ = _systems_only(spark, sf_dir, rain=True)
    return metrics.precip_max_min(nodes, rain).withColumn("min_rate", r6("min_rate")).withColumn("max_rate", r6("max_rate"))


def element_speed(spark, sf_dir):
    nodes, clusters, _, _ = _systems_only(spark, sf_dir)
    return metrics.element_speed(nodes, clusters.edges, CONFIG).withColumn("speed", r6("speed"))


def feature_report(spark, sf_dir):
    report = metrics.feature_report(_systems_only(spark, sf_dir, rain=True)[0], CONFIG)
    return _round_doubles(report)


def summary_report(spark, sf_dir):
    return _round_doubles(metrics.summary_report(_systems_only(spark, sf_dir, rain=True)[0], CONFIG))


def complex_report(spark, sf_dir):
    """Per-feature values of the confirmed complexes, averages over their mature members."""
    return _round_doubles(metrics.feature_report(_analysis(spark, sf_dir, rain=True).nodes("MCC"), CONFIG))


def _round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[r6(n) if t == "double" else F.col(n) for n, t in df.dtypes])


# --- figure data -----------------------------------------------------------------------------------------------

def size_classes(spark, sf_dir):
    return plot_data.size_points(_systems_only(spark, sf_dir)[0])


def size_limits(spark, sf_dir):
    return plot_data.size_limits(_systems_only(spark, sf_dir)[0])


def precip_share(spark, sf_dir):
    nodes = _systems_only(spark, sf_dir, rain=True)[0]
    return _round_doubles(plot_data.precip_points(nodes))


def accum_range(spark, sf_dir):
    raster, _, rain = _wet_elements(spark, sf_dir)
    summed = plot_data.rain_in_range(rain, raster.frames, "2024-01-03_00:00:00", "2024-01-20_12:00:00", 24)
    return summed.withColumn("rain", r6("rain"))


def accum_running(spark, sf_dir):
    """Rain of every cell since the first frame, in blocks of a week."""
    _, _, rain = _wet_elements(spark, sf_dir)
    return plot_data.running_rain(rain, 7).select("frame", "r", "c", r6("rain"), r6("running"))


def accum_feature(spark, sf_dir):
    nodes, _, rain, _ = _systems_only(spark, sf_dir, rain=True)
    return plot_data.rain_per_feature(nodes, rain).withColumn("rain", r6("rain"))


def element_precip_histogram(spark, sf_dir):
    nodes, _, rain, _ = _systems_only(spark, sf_dir, rain=True)
    return _rounded_bins(plot_data.element_rain_histogram(nodes, rain))


def feature_precip_histogram(spark, sf_dir):
    nodes, _, rain, _ = _systems_only(spark, sf_dir, rain=True)
    return _rounded_bins(plot_data.feature_rain_histogram(nodes, rain))


def masked_frames(spark, sf_dir):
    # fixed values: display levels of the published figure
    return plot_data.masked_frames(data.raster(spark, sf_dir).pixels, [190, 200, 210, 220, 230, 240, 250])


def frame_composite(spark, sf_dir):
    return plot_data.frame_composite(_elements(spark, sf_dir)[1].pixels)


# --- utilities ---------------------------------------------------------------------------------------------------

def valid_date(spark, sf_dir):
    key, when = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(key % 4 == 0, F.date_format(when, "yyyyMMddHH"))
        .when(key % 4 == 1, F.date_format(when, "yyyyMMddHHmm"))
        .when(key % 4 == 2, F.date_format(when, "yyyy-MM-dd HH:mm"))
        .otherwise(F.lpad((key * 104729 % 10000000000).cast("string"), 10, "2"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.valid_date(text).alias("valid"))


def time_step_class(spark, sf_dir):
    # fixed values: time units in file order
    unit = F.element_at(F.array(*[F.lit(u) for u in ("minutes", "hours", "days", "months", "years")]),
                        (F.col("l_orderkey") % 5 + 1).cast("int"))
    step = F.col("l_quantity").cast("int") * F.when(F.col("l_linenumber") % 2 == 0, 24).otherwise(1)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", unit.alias("unit"), step.alias("step"),
        dates.time_step_class(unit, step, on_error="null").alias("step_class"))


def model_time(spark, sf_dir):
    units = F.concat(
        F.element_at(F.array(*[F.lit(u) for u in ("minutes", "hours", "days", "months", "years")]),
                     (F.col("o_custkey") % 5 + 1).cast("int")),
        F.lit(" since "), F.date_format("o_orderdate", "yyyy-MM-dd HH"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.decode_model_time(units, (F.col("o_custkey") % 50) / 4).alias("ts"))


def time_pattern(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyyMMddHHmm")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.fill_time_pattern(text, F.lit("20090831*00*")).alias("pattern"))


def missing_files(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    names = orders.select(F.concat(F.lit("grid_"), F.date_format("o_orderdate", "yyyyMMddHH"), F.lit("_4km.nc")).alias("name"))
    found = names.select("name", files.file_time("name").alias("ts"))
    low, high = orders.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    expected = files.expected_times(spark, low.replace(hour=0, minute=0, second=0, microsecond=0), high, 6, "hour")
    return files.missing_times(found, expected, "hour")


def element_file_names(spark, sf_dir):
    raster, found = _elements(spark, sf_dir)
    name = dates.element_file_name("ts", "id")
    return found.accepted.select(name.alias("name"), dates.parse_element_file(name).alias("p")).select("name", "p.*")


def compare_runs(spark, sf_dir):
    """Elements of the box mode against those of the component mode."""
    left, right = _elements(spark, sf_dir)[1], _elements(spark, sf_dir, COMPONENT)[1]
    return compare.compare_elements(left.pixels, right.pixels)


def compare_nodes(spark, sf_dir):
    """Elements of the default run against those of a stricter one."""
    left, right = _elements(spark, sf_dir)[1], _elements(spark, sf_dir, STRICT)[1]
    return compare.only_in_one(left.accepted, right.accepted, ["frame", "ce_no"])


Query = Callable[[SparkSession, str], DataFrame]

REGISTERED: list[Query] = [
    grid_raster, mask_threshold, clip_domain, nearest_axis, time_filter, lon_normalize,
    label_components, label_components_tiled, element_bbox, element_stats, element_stats_component,
    element_shape, element_center, element_accept, element_ids, element_reject, element_pixels,
    element_pixel_list, netcdf_round_trip, overlap_pairs, edges_weighted, isolated_removed, frame_counts, graph_json,
    edge_classes, contiguous_links, path_depth, path_depth_min_distance, root_path_list, pruned_edges, components,
    merge_split, ancestors_chain, descendants_chain, criteria_area, criterion_pixels, mcs_members,
    mcc_members, node_stage, asof_bucket, regrid_feather, regrid_bilinear, regrid_cubic, element_precip,
    precip_late_attach, stored_rain, stored_stages, feature_duration, duration_summary, feature_area, average_feature_size,
    avg_time_of_day, size_histogram, value_histogram, precip_islands, precip_minmax, element_speed,
    feature_report, summary_report, complex_report, size_classes, size_limits, precip_share,
    accum_range, accum_running, asof_events, element_precip_asof, accum_feature, element_precip_histogram, feature_precip_histogram, masked_frames,
    frame_composite, valid_date, time_step_class, model_time, time_pattern, missing_files,
    element_file_names, compare_runs, compare_nodes,
]


def registered() -> dict[str, Query]:
    return {query.__name__: query for query in REGISTERED}
