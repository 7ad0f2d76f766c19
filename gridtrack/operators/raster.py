"""The gridded input as long tables, and the operators that cut it down.

``Raster`` bundles what the later stages share: one row per kept pixel, the two
axis tables (one row per grid line) and the frame table.  The tables are lazy,
so clip and mask filters reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtrack.config import TrackConfig
from gridtrack.functions.geo import normalize_longitude
from gridtrack.session import stage


@dataclass(frozen=True)
class Raster:
    """``pixels(frame, r, c, tb)``, ``rows(r, lat)``, ``cols(c, lon)``, ``frames(frame, ts)``."""

    pixels: DataFrame
    rows: DataFrame
    cols: DataFrame
    frames: DataFrame


def raster_from_grid(grid: DataFrame, config: TrackConfig, clip: bool = True,
                     known: Dimensions | None = None) -> Raster:
    """Build the raster from ``grid(frame, ts, r, c, lat, lon, tb)``.

    ``known`` supplies the full axes and frames where the long table omits empty
    lines or frames.  Longitudes are folded if ``config.fold_longitudes`` says so.
    Raises on an empty grid.
    """
    if grid.isEmpty():
        raise ValueError("the grid has no rows: check the input path and period")
    dims = known or grid_dimensions(grid, config.fold_longitudes)
    rows, cols = dims.rows, dims.cols
    kept = grid
    if clip:
        rows, cols = clip_axes(rows, cols, config)
        kept = _within(_within(kept, rows, "r"), cols, "c")
    return Raster(mask_temperature(kept, config), rows, cols, dims.frames)


def _within(grid: DataFrame, axis: DataFrame, index: str) -> DataFrame:
    """Keep the lines of ``axis``; the range reaches the scan, gaps are closed by a semi join."""
    low, high, lines = axis.agg(F.min(index), F.max(index), F.count(index)).first()
    if not lines:
        raise ValueError("the requested domain holds no grid cell")
    kept = grid.where(F.col(index).between(low, high))
    return kept if high - low + 1 == lines else kept.join(axis.select(index), index, "left_semi")


@dataclass(frozen=True)
class Dimensions:
    """``rows(r, lat)``, ``cols(c, lon)`` and ``frames(frame, ts)``."""

    rows: DataFrame
    cols: DataFrame
    frames: DataFrame


def grid_dimensions(grid: DataFrame, fold: bool = True) -> Dimensions:
    """Axes and frame table of a long grid, from one pass over it.

    ``fold`` brings 0..360 longitudes to -180..180; without it they stay as they are.

    Lines and frames are collapsed inside each task before the shuffle.  The
    stage table lets later joins see how small the three are.
    """
    none = F.lit(None).cast("timestamp_ntz")
    lines = stage(
        grid.select(F.explode(F.array(
            F.struct(F.lit("r").alias("axis"), F.col("r").cast("int").alias("line"),
                     F.col("lat").cast("double").alias("place"), none.alias("ts")),
            F.struct(F.lit("c").alias("axis"), F.col("c").cast("int").alias("line"),
                     F.col("lon").cast("double").alias("place"), none.alias("ts")),
            F.struct(F.lit("f").alias("axis"), F.col("frame").cast("int").alias("line"),
                     F.lit(None).cast("double").alias("place"), F.col("ts").alias("ts")),
        )).alias("x")).select("x.*").groupBy("axis", "line").agg(
            F.min("place").alias("place"), F.min("ts").alias("ts")), "dimensions")
    return Dimensions(
        lines.where("axis = 'r'").select(F.col("line").alias("r"), F.col("place").alias("lat")),
        lines.where("axis = 'c'").select(F.col("line").alias("c"), (normalize_longitude("place") if fold else F.col("place")).alias("lon")),
        lines.where("axis = 'f'").select(F.col("line").alias("frame"), "ts"),
    )


def nearest_on_axis(axis: DataFrame, index: str, value: str, target: float | Column) -> DataFrame:
    """The axis line closest to ``target``; the lower index wins a tie."""
    gap = F.abs(F.col(value) - F.lit(target))
    order = F.struct(gap, F.col(index))
    return axis.agg(F.min_by(index, order).alias(index), F.min_by(value, order).alias(value))


def clip_axes(rows: DataFrame, cols: DataFrame, config: TrackConfig) -> tuple[DataFrame, DataFrame]:
    """Axis lines from the one nearest the minimum up to, not including, the one nearest the maximum.

    Lines are selected by coordinate, so a domain across the fold of a 0..360
    axis keeps its cells.
    """
    return (
        _clip_axis(rows, "r", "lat", config.lat_min, config.lat_max),
        _clip_axis(cols, "c", "lon", config.lon_min, config.lon_max),
    )


def _clip_axis(axis: DataFrame, index: str, value: str, low: float, high: float) -> DataFrame:
    start = nearest_on_axis(axis, index, value, low).first()[value]
    stop = nearest_on_axis(axis, index, value, high).first()[value]
    if start is None:
        raise ValueError("the grid has no axis lines")
    return axis.where((F.col(value) >= start) & (F.col(value) < stop))


def mask_temperature(grid: DataFrame, config: TrackConfig) -> DataFrame:
    """Keep cloudy pixels: whole kelvins (fraction dropped first) not above the threshold."""
    tb = F.col("tb").cast("smallint")
    limit = F.lit(config.t_bb_max)
    # the raw comparison is implied by the exact one and is what the scan can push down
    return (
        grid.where(F.col("tb") < limit + 1).where((tb <= limit) & (tb != 0))
        .select(
            F.col("frame").cast("int").alias("frame"), F.col("r").cast("int").alias("r"),
            F.col("c").cast("int").alias("c"), tb.alias("tb"),
        )
    )


def between_times(grid: DataFrame, config: TrackConfig) -> DataFrame:
    """Rows of the configured period, both ends included."""
    low, high = (F.lit(t.isoformat(" ")).cast("timestamp_ntz") for t in (config.start_time, config.end_time))
    return grid.where(F.col("ts").between(low, high))
