"""Elements: the regions of every frame with their box statistics.

In ``bbox`` mode the statistics, area and pixel list of an element cover every
cloudy pixel inside its bounding box, so a pixel can count for several
elements; in ``component`` mode they cover the region only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtrack.config import TrackConfig
from gridtrack.functions.geo import eccentricity
from gridtrack.operators.boxes import BOX, box_statistics
from gridtrack.operators.labeling import label_pixels, region_summary
from gridtrack.operators.numbering import number_rows
from gridtrack.operators.raster import Raster
from gridtrack.session import stage

BOX_CELL = 32


@dataclass(frozen=True)
class Elements:
    """``accepted`` and ``rejected`` elements and the pixels of the accepted ones."""

    accepted: DataFrame
    rejected: DataFrame
    pixels: DataFrame


def scoped(pixels: DataFrame) -> DataFrame:
    return pixels.select(F.col("frame").cast("bigint").alias("scope"), "r", "c", "tb")


def element_boxes(raster: Raster, config: TrackConfig) -> DataFrame:
    """``(frame, label, r0, r1, c0, c1)`` and the region's own sums, one row per region."""
    return (
        region_summary(scoped(raster.pixels), config.tile)
        .withColumn("frame", F.col("scope").cast("int")).drop("scope")
    )


def pixels_in_boxes(pixels: DataFrame, boxes: DataFrame, keep: list[str]) -> DataFrame:
    """Pixels paired with every box of their frame that covers them.

    Boxes are spread over the 32 x 32 cells they touch, so the join runs on
    ``(frame, cell)``: at most 1024 pixels meet the boxes of one cell and a
    crowded frame is many keys.
    """
    spread = (
        boxes.select("frame", "r0", "r1", "c0", "c1", *keep)
        .withColumn("cr", F.explode(F.sequence(_cell("r0"), _cell("r1"))))
        .withColumn("cc", F.explode(F.sequence(_cell("c0"), _cell("c1"))))
    )
    cells = pixels.select("frame", "r", "c", "tb", _cell("r").alias("cr"), _cell("c").alias("cc"))
    return (
        cells.join(spread, ["frame", "cr", "cc"])
        .where(F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1")))
        .drop("cr", "cc")
    )


def _cell(name: str) -> Column:
    return F.expr(f"{name} div {BOX_CELL}")


def element_stats(raster: Raster, boxes: DataFrame, config: TrackConfig) -> DataFrame:
    """Area, temperature statistics, shape and centre cell of every region."""
    if config.element_mode == "component":
        sums = boxes.withColumnRenamed("n", "n_px")
    else:
        sums = _box_sums(raster, boxes, config)
    mean = F.col("tb_sum") / F.col("n_px")
    measured = sums.select(
        "frame", "label", "r0", "r1", "c0", "c1", "n_px",
        F.col("tmin").cast("double").alias("tmin"), F.col("tmax").cast("double").alias("tmax"),
        mean.alias("bt_avg"), (F.col("tb_sq") / F.col("n_px") - mean * mean).alias("bt_var"),
        ((F.col("tb_r") - F.col("r0") * F.col("tb_sum")) / F.col("tb_sum")).alias("dr"),
        ((F.col("tb_c") - F.col("c0") * F.col("tb_sum")) / F.col("tb_sum")).alias("dc"),
    )
    ratio = F.col("tmin") / F.col("tmax")
    area = F.col("n_px") * F.lit(config.cell_area)
    return measured.select(
        "frame", "label", "r0", "r1", "c0", "c1", "n_px", area.alias("area"),
        "tmin", "tmax", "bt_avg", "bt_var", (ratio * 100).alias("cf"),
        eccentricity(F.expr("r1 - r0 + 1"), F.expr("c1 - c0 + 1")).alias("eccentricity"),
        (F.col("r0") + F.round("dr")).cast("int").alias("center_r"),
        (F.col("c0") + F.round("dc")).cast("int").alias("center_c"),
        accepts(area, ratio, config).alias("accepted"),
    )


def _box_sums(raster: Raster, boxes: DataFrame, config: TrackConfig) -> DataFrame:
    """Sums over all pixels of each box: from the labelling where one tile holds it, from all tiles it touches elsewhere."""
    names = {"n_px": "box_n", "tb_sum": "box_sum", "tb_sq": "box_sq", "tb_r": "box_r", "tb_c": "box_c", "tmin": "box_min", "tmax": "box_max"}
    within = boxes.where("open = 0").select(*BOX, *[F.col(held).alias(name) for name, held in names.items()])
    beyond = boxes.where("open = 1")
    if beyond.isEmpty():
        return within
    return within.unionByName(box_statistics(raster.pixels, beyond, config.tile))


def accepts(area: Column, ratio: Column, config: TrackConfig) -> Column:
    """Large enough, or small with a strong enough temperature contrast."""
    return (area >= config.area_min) | (ratio < config.convective_fraction)


def with_coordinates(stats: DataFrame, raster: Raster) -> DataFrame:
    """Add time, centre and corner coordinates from the axis tables."""
    def line(axis: DataFrame, index: str, value: str, as_index: str, as_value: str) -> DataFrame:
        return axis.select(F.col(index).alias(as_index), F.col(value).alias(as_value))

    out = stats.join(raster.frames, "frame")
    for index, value in (("center_r", "center_lat"), ("r0", "lat_a"), ("r1", "lat_b")):
        out = out.join(line(raster.rows, "r", "lat", index, value), index, "left")
    for index, value in (("center_c", "center_lon"), ("c0", "lon_a"), ("c1", "lon_b")):
        out = out.join(line(raster.cols, "c", "lon", index, value), index, "left")
    return (
        out.withColumn("min_lat", F.least("lat_a", "lat_b")).withColumn("max_lat", F.greatest("lat_a", "lat_b"))
        .withColumn("min_lon", F.least("lon_a", "lon_b")).withColumn("max_lon", F.greatest("lon_a", "lon_b"))
        .drop("lat_a", "lat_b", "lon_a", "lon_b")
    )


def number_elements(accepted: DataFrame) -> DataFrame:
    """Ids ``F<frame>CE<n>``: accepted elements of a frame counted in raster order."""
    by_row = accepted.withColumn("first_row", F.shiftright("label", 32))
    return (
        number_rows(by_row, "frame", "first_row", ["label"], "ce_no").drop("first_row")
        .withColumn("id", element_id("frame", "ce_no"))
    )


def element_id(frame: str, ce_no: str) -> Column:
    return F.concat(F.lit("F"), F.col(frame).cast("string"), F.lit("CE"), F.col(ce_no).cast("string"))


def node_key(frame: str = "frame", ce_no: str = "ce_no") -> Column:
    """Sortable element number: frame in the high half, element in the low half."""
    return F.shiftleft(F.col(frame).cast("bigint"), 32).bitwiseOR(F.col(ce_no).cast("bigint"))


def node_frame(node: str) -> Column:
    return F.shiftright(F.col(node), 32).cast("int")


def node_number(node: str) -> Column:
    return F.col(node).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def element_pixels(raster: Raster, accepted: DataFrame, config: TrackConfig) -> DataFrame:
    """``(frame, ce_no, r, c, tb)``: the pixels that count for each accepted element."""
    if config.element_mode == "component":
        labelled = (
            label_pixels(scoped(raster.pixels), config.tile)
            .withColumn("frame", F.col("scope").cast("int"))
        )
        return (
            labelled.join(accepted.select("frame", "label", "ce_no"), ["frame", "label"])
            .select("frame", "ce_no", "r", "c", "tb")
        )
    return (
        pixels_in_boxes(raster.pixels, accepted, ["ce_no"]).select("frame", "ce_no", "r", "c", "tb")
    )


def find_elements(raster: Raster, config: TrackConfig) -> Elements:
    """Label, measure, accept and number the elements of all frames."""
    boxes = element_boxes(raster, config)
    stats = stage(with_coordinates(element_stats(raster, boxes, config), raster), "element-stats")
    accepted = stage(
        number_elements(stats.where("accepted").drop("accepted")).withColumn("node", node_key()),
        "elements",
    )
    rejected = stats.where("not accepted").drop("accepted")
    return Elements(accepted, rejected, element_pixels(raster, accepted, config))


def element_records(elements: DataFrame) -> DataFrame:
    """The published record of each element; its pixel list stays a child table."""
    return elements.select(
        F.col("id").alias("unique_id"), "ts",
        F.struct(F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon")).alias("center"),
        "area", "eccentricity", "tmax", "tmin", "cf",
        F.struct("min_lon", "min_lat", "max_lon", "max_lat").alias("box"),
        "bt_var", "bt_avg",
    )


def pixel_list(pixels: DataFrame, raster: Raster) -> DataFrame:
    """Pixel rows of each element with coordinates, numbered by latitude then raster order."""
    located = (
        pixels.withColumn("node", node_key()).join(raster.rows, "r").join(raster.cols, "c")
    )
    return (
        number_rows(located, "node", "lat", ["r", "c"], "seq")
        .select("frame", "ce_no", "seq", "r", "c", "lat", "lon", "tb")
    )
