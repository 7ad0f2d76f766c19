"""Attaching the second dataset (rainfall) to the elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrack.config import TrackConfig
from gridtrack.functions.dates import floor_to_hours
from gridtrack.operators.asof import asof_join
from gridtrack.operators.raster import Raster
from gridtrack.operators.regrid import coarse_grid, regrid_bilinear
from gridtrack.session import stage

PRECIP_COLUMNS = ("precip_total", "precip_area", "precip_max", "precip_min")


def rain_slices(frames: DataFrame, source: DataFrame, hours: int = 3, tolerance: float | None = None) -> DataFrame:
    """``(frame, ts)``: time of the source slice that counts for each frame.

    It is the frame's time cut to ``hours``, or with a ``tolerance`` in hours the latest time of the
    source not later than the frame and not older than that, so sources with gaps and odd times can be
    attached.  Frames without one are left out then.
    """
    if tolerance is None:
        return frames.select("frame", floor_to_hours("ts", hours).alias("ts"))
    found = asof_join(frames.select("frame", "ts"), source.select("ts").distinct(), [], [], tolerance * 3600)
    return found.where("right_ts is not null").select("frame", F.col("right_ts").alias("ts"))


def element_rain(pixels: DataFrame, source: DataFrame, raster: Raster, hours: int = 3, tolerance: float | None = None,
                 fold: bool = True, axes: DataFrame | None = None) -> DataFrame:
    """``(frame, ce_no, r, c, rain)``: interpolated rain on the cells of each element.

    Slices are chosen by ``rain_slices``, longitudes folded by ``coarse_grid``.  Cells without rain are absent.
    The coarse grid has the lines of the whole ``source``, or of ``axes(lat, lon)`` if the source has gaps.
    """
    slices = rain_slices(raster.frames, source, hours, tolerance)
    wanted = stage(source.join(slices, "ts", "left_semi"), "rain-slices")
    targets = pixels.select("frame", "ce_no", "r", "c").join(slices, "frame")
    rain = regrid_bilinear(coarse_grid(wanted, fold, source if axes is None else axes), raster.rows, raster.cols, targets)
    return rain.where(F.col("value") != 0).select("frame", "ce_no", "r", "c", F.col("value").alias("rain"))


def rain_sums(rain: DataFrame, config: TrackConfig) -> DataFrame:
    """Total, area, largest and smallest non-zero rate per element."""
    return rain.groupBy("frame", "ce_no").agg(
        F.sum("rain").alias("precip_total"),
        (F.count("rain") * F.lit(config.cell_area)).alias("precip_area"),
        F.max("rain").alias("precip_max"), F.min("rain").alias("precip_min"),
    )


def attach_rain(elements: DataFrame, rain: DataFrame, config: TrackConfig) -> DataFrame:
    """Elements with the four rain columns.

    Values already present win over new ones, and elements without rain get
    zeros, so the dataset can be attached before or after the graph is built.
    """
    fresh = rain_sums(rain, config).select(
        "frame", "ce_no", *[F.col(name).alias(f"new_{name}") for name in PRECIP_COLUMNS])
    out = elements.join(fresh, ["frame", "ce_no"], "left")
    for name in PRECIP_COLUMNS:
        known = [F.col(name)] if name in elements.columns else []
        out = out.withColumn(name, F.coalesce(*known, F.col(f"new_{name}"), F.lit(0.0)))
    return out.drop(*[f"new_{name}" for name in PRECIP_COLUMNS])
