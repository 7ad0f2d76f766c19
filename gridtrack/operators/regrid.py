"""Interpolation of a coarse dataset onto the fine grid's lines.

The source is ``(ts, lat, lon, value)``; its axes are sorted by coordinate and
taken as evenly spaced.  The coarse cells are first arranged as 2 x 2 blocks, so
a fine cell needs one equality join to find its four neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtrack.functions.geo import normalize_longitude
from gridtrack.session import stage


@dataclass(frozen=True)
class AxisInfo:
    size: int
    low: float
    high: float


@dataclass(frozen=True)
class CoarseGrid:
    """``cells(ts, y, x, value, missing)`` with the limits of both axes."""

    cells: DataFrame
    lat: AxisInfo
    lon: AxisInfo


def coarse_grid(source: DataFrame, fold: bool = True, axes: DataFrame | None = None) -> CoarseGrid:
    """Index the coarse dataset; negative, NULL and absent values are missing.

    ``fold`` brings 0..360 longitudes to -180..180, as it must be done to the fine grid as well.
    ``axes(lat, lon)`` holds the lines of the whole dataset where ``source`` is a part of it, as some
    slices can lack whole lines.
    """
    lon = normalize_longitude("lon") if fold else F.col("lon")
    folded = stage(source.select("ts", "lat", lon.alias("lon"), "value"), "coarse-source")
    full = folded if axes is None else axes.select("lat", lon.alias("lon"))
    # every grid line once: axes and limits come from this small table
    lines = stage(
        full.select(F.explode(F.array(
            F.struct(F.lit("lat").alias("axis"), F.col("lat").alias("place")),
            F.struct(F.lit("lon").alias("axis"), F.col("lon").alias("place")))).alias("x"))
        .select("x.*").distinct(), "coarse-lines")
    lat_axis, lon_axis = _axis(lines, "lat", "y"), _axis(lines, "lon", "x")
    lat, lon = _axis_infos(lines)
    given = (
        folded.join(lat_axis, "lat").join(lon_axis, "lon")
        .select("ts", "y", "x", F.col("value").cast("double").alias("value"))
    )
    every = (
        folded.select("ts").distinct()
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(lat.size - 1))))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(lon.size - 1))))
    )
    cells = every.join(given, ["ts", "y", "x"], "left").withColumn(
        "missing", F.col("value").isNull() | (F.col("value") < 0))
    return CoarseGrid(stage(cells, "coarse-cells"), lat, lon)


def _axis(lines: DataFrame, name: str, index: str) -> DataFrame:
    # a window over one row per grid line
    place = F.row_number().over(Window.orderBy("place")) - 1
    return lines.where(F.col("axis") == name).select(F.col("place").alias(name), place.alias(index))


def _axis_infos(lines: DataFrame) -> tuple[AxisInfo, AxisInfo]:
    of = {name: F.when(F.col("axis") == name, F.col("place")) for name in ("lat", "lon")}
    limits = lines.agg(*[f(of[x]) for x in ("lat", "lon") for f in (F.count, F.min, F.max)]).first()
    lat, lon = AxisInfo(*limits[:3]), AxisInfo(*limits[3:])
    if min(lat.size, lon.size) < 2:
        raise ValueError("interpolation needs at least two lines on each axis")
    return lat, lon


def feather(grid: CoarseGrid) -> CoarseGrid:
    """Fill missing cells from a valid neighbour; the grid wraps at its edges.

    Left wins over above, above over right, right over below.  Cells without a
    valid neighbour keep their raw value; ``missing`` stays set either way.
    """
    valid = grid.cells.where(~F.col("missing"))
    ny, nx = grid.lat.size, grid.lon.size
    # fixed values: (rank, rows down, columns right) from a donor to the cell it fills
    moves = [(4, 0, 1), (3, 1, 0), (2, 0, -1), (1, -1, 0)]
    donors = valid.select(
        "ts", "value", F.explode(F.array(*[
            F.struct(F.lit(rank).alias("rank"), F.pmod(F.col("y") + dy, F.lit(ny)).alias("y"),
                     F.pmod(F.col("x") + dx, F.lit(nx)).alias("x"))
            for rank, dy, dx in moves])).alias("to"),
    ).select("ts", "to.*", "value")
    gaps = grid.cells.where("missing")
    fills = (
        donors.join(gaps.select("ts", "y", "x"), ["ts", "y", "x"], "left_semi")
        .groupBy("ts", "y", "x").agg(F.max_by("value", "rank").alias("fill"))
    )
    cells = (
        grid.cells.join(fills, ["ts", "y", "x"], "left")
        .select("ts", "y", "x", F.when(F.col("missing"), F.coalesce("fill", "value"))
                .otherwise(F.col("value")).alias("value"), "missing")
    )
    return CoarseGrid(cells, grid.lat, grid.lon)


def blocks(grid: CoarseGrid) -> DataFrame:
    """``(ts, y, x, v00, v01, v10, v11, m00..m11)``: each cell with its neighbours up and right."""
    corners = [("00", 0, 0), ("01", 0, 1), ("10", 1, 0), ("11", 1, 1)]
    spread = grid.cells.select(
        "ts", "value", "missing", F.explode(F.array(*[
            F.struct(F.lit(name).alias("corner"), (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"))
            for name, dy, dx in corners])).alias("at"),
    ).select("ts", "at.*", "value", "missing").where("y >= 0 and x >= 0")
    return spread.groupBy("ts", "y", "x").agg(
        *[F.max(F.when(F.col("corner") == name, F.col("value"))).alias(f"v{name}") for name, _, _ in corners],
        *[F.max(F.when(F.col("corner") == name, F.col("missing").cast("int"))).alias(f"m{name}")
          for name, _, _ in corners],
    )


def line_weights(axis: DataFrame, index: str, value: str, info: AxisInfo, cell: str) -> DataFrame:
    """Per fine grid line: lower coarse index, share of the upper one, and whether it is inside."""
    inside = F.greatest(F.least(F.col(value), F.lit(info.high)), F.lit(info.low))
    place = (info.size - 1) * (inside - info.low) / (info.high - info.low)
    return axis.select(
        index, F.floor(place).cast("int").alias(cell), (place - F.floor(place)).alias(f"w{cell}"),
        ((F.col(value) > info.low) & (F.col(value) < info.high)).alias(f"in_{cell}"),
    )


def regrid_bilinear(grid: CoarseGrid, rows: DataFrame, cols: DataFrame, targets: DataFrame | None = None,
                    mask_outside: bool = False, propagate_missing: bool = False) -> DataFrame:
    """Bilinear values at ``targets(ts, r, c, ...)``, or at every fine cell when none are given.

    Points outside the coarse domain take the edge value unless
    ``mask_outside``; ``propagate_missing`` blanks cells that touch a missing one.
    """
    filled = feather(grid)
    quads = blocks(filled)
    row_w = line_weights(rows, "r", "lat", grid.lat, "y")
    col_w = line_weights(cols, "c", "lon", grid.lon, "x")
    if targets is None:
        joined = quads.join(row_w, "y").join(col_w, "x")
    else:
        joined = targets.join(row_w, "r").join(col_w, "c").join(quads, ["ts", "y", "x"], "left")
    wy, wx = F.col("wy"), F.col("wx")
    shares = {"00": (1 - wy) * (1 - wx), "01": (1 - wy) * wx, "10": wy * (1 - wx), "11": wy * wx}
    value = sum((_part(share, F.col(f"v{name}")) for name, share in shares.items()), F.lit(0.0))
    if mask_outside:
        value = F.when(F.col("in_y") & F.col("in_x"), value)
    if propagate_missing:
        touched = sum((_part(share, F.col(f"m{name}").cast("double")) for name, share in shares.items()), F.lit(0.0))
        value = F.when(touched == 0, value)
    kept = ["ts", "r", "c"] if targets is None else targets.columns
    return joined.select(*kept, value.alias("value"))


def _part(share: Column, corner: Column) -> Column:
    """A corner's contribution; a corner without weight cannot blank the sum."""
    return F.when(share == 0, 0.0).otherwise(share * corner)


# --- cubic ------------------------------------------------------------------------------------

SLICE_SCHEMA = "ts timestamp_ntz, y int, x int, value double"


def regrid_cubic(grid: CoarseGrid, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Cubic-spline values ``(ts, r, c, value)`` at every fine cell.

    The spline is separable: the coefficients of a slice of the coarse grid are
    solved along one axis and then the other, all its lines at once; then every
    fine line sums four weighted coarse lines, first along columns, then along
    rows.  The grid is mirrored at its edges.
    """
    cells = feather(grid).cells.select(
        "ts", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"),
        F.coalesce("value", F.lit(0.0)).alias("value"))
    coefficients = cells.groupBy("ts").applyInArrow(_spline_slice(grid.lat.size, grid.lon.size), SLICE_SCHEMA)
    col_taps = _taps(line_weights(cols, "c", "lon", grid.lon, "x"), "c", "x", grid.lon.size)
    row_taps = _taps(line_weights(rows, "r", "lat", grid.lat, "y"), "r", "y", grid.lat.size)
    by_column = coefficients.join(col_taps, "x").groupBy("ts", "y", "c").agg(
        F.sum(F.col("tap") * F.col("value")).alias("value"))
    return by_column.join(row_taps, "y").groupBy("ts", "r", "c").agg(
        F.sum(F.col("tap") * F.col("value")).alias("value"))


def _taps(weights: DataFrame, index: str, cell: str, size: int) -> DataFrame:
    """``(index, cell, tap)``: the four coarse lines around a fine line and their B-spline weights."""
    t = F.col(f"w{cell}")
    # fixed values: the cubic B-spline at distances 1 + t, t, 1 - t and 2 - t
    shares = [(1 - t) * (1 - t) * (1 - t) / 6, (4 - 6 * t * t + 3 * t * t * t) / 6,
              (1 + 3 * t + 3 * t * t - 3 * t * t * t) / 6, t * t * t / 6]
    taps = weights.select(index, F.explode(F.array(*[
        F.struct((F.col(cell) + step).alias("at"), share.alias("tap"))
        for step, share in zip((-1, 0, 1, 2), shares)])).alias("x")).select(index, "x.at", "x.tap")
    turn = 2 * (size - 1)
    folded = F.pmod(F.col("at"), F.lit(turn))
    mirrored = F.when(folded < size, folded).otherwise(turn - folded)
    return taps.where("tap <> 0").select(index, mirrored.cast("int").alias(cell), "tap")


def _spline_slice(ny: int, nx: int):
    """Kernel: B-spline coefficients of one coarse slice, mirrored at its edges."""
    def solve(cells: pa.Table) -> pa.Table:
        y, x = cells.column("y").to_numpy(), cells.column("x").to_numpy()
        values = np.zeros((ny, nx))
        values[y, x] = cells.column("value").to_numpy()
        values = spline_coefficients(spline_coefficients(values).T).T
        return cells.set_column(cells.column_names.index("value"), "value", pa.array(values[y, x])).select(["ts", "y", "x", "value"])

    return solve


def spline_coefficients(samples: np.ndarray) -> np.ndarray:
    """Solve ``(c[i-1] + 4 c[i] + c[i+1]) / 6 = samples[i]`` along the last axis, with mirrored ends.

    The elimination runs along the line, one step for all lines together.
    """
    n = samples.shape[-1]
    upper, right = np.zeros(n), np.zeros(samples.shape)
    for i in range(n):
        above = (2.0 if i == 0 else 1.0) if i < n - 1 else 0.0
        below = (2.0 if i == n - 1 else 1.0) if i > 0 else 0.0
        pivot = 4.0 - (below * upper[i - 1] if i else 0.0)
        upper[i] = above / pivot
        right[..., i] = (6.0 * samples[..., i] - (below * right[..., i - 1] if i else 0.0)) / pivot
    for i in range(n - 2, -1, -1):
        right[..., i] -= upper[i] * right[..., i + 1]
    return right
