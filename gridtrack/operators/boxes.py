"""Statistics of many boxes over one grid, without pairing pixels and boxes.

A frame is cut into square tiles and every box into one piece per tile that it
touches.  A tile builds summed-area tables of its pixels once, so the sums of a
piece are four corner reads however large it is; smallest and largest values are
read from sparse tables of power-of-two windows.  Pieces of a box add up.  Pixels
are shuffled once whatever the number of boxes, and a group is at most
``tile * tile`` pixels and the pieces inside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrack.session import ship_package

PIECE_SCHEMA = "frame int, label bigint, r0 int, r1 int, c0 int, c1 int, n_px bigint, tb_sum bigint, tb_sq bigint, tb_r bigint, tb_c bigint, tmin int, tmax int"
BOX = ["frame", "label", "r0", "r1", "c0", "c1"]
#: no pixel value
NONE = np.int32(2**31 - 1)


def box_statistics(pixels: DataFrame, boxes: DataFrame, tile: int) -> DataFrame:
    """Boxes with count, sums, smallest and largest value of all pixels inside each.

    ``tb_sq`` sums squares, ``tb_r`` and ``tb_c`` values times row and column.
    Boxes are ``(frame, label, r0, r1, c0, c1)``, both ends included; one without
    a pixel gives no row.
    """
    ship_package(pixels.sparkSession)
    cells = pixels.select("frame", F.expr(f"r div {tile}").alias("tr"), F.expr(f"c div {tile}").alias("tc"), "r", "c", "tb")
    pieces = (
        boxes.select(*BOX)
        .withColumn("tr", F.explode(F.expr(f"sequence(r0 div {tile}, r1 div {tile})")))
        .withColumn("tc", F.explode(F.expr(f"sequence(c0 div {tile}, c1 div {tile})")))
    )
    keys = ("frame", "tr", "tc")
    found = cells.groupBy(*keys).cogroup(pieces.groupBy(*keys)).applyInArrow(_tile_statistics, PIECE_SCHEMA)
    sums = [F.sum(x).alias(x) for x in ("n_px", "tb_sum", "tb_sq", "tb_r", "tb_c")]
    return found.groupBy(*BOX).agg(*sums, F.min("tmin").alias("tmin"), F.max("tmax").alias("tmax"))


def _tile_statistics(pixels: pa.Table, boxes: pa.Table) -> pa.Table:
    columns = [name.split()[0] for name in PIECE_SCHEMA.split(", ")]
    found = {name: np.zeros(0, dtype=np.int64) for name in columns}
    if pixels.num_rows and boxes.num_rows:
        r, c, tb = (pixels.column(x).to_numpy().astype(np.int64) for x in ("r", "c", "tb"))
        found = {name: boxes.column(name).to_numpy().astype(np.int64) for name in BOX}
        found |= dict(zip(columns[len(BOX):], piece_statistics(r, c, tb, *(found[name] for name in BOX[2:]))))
        held = found["n_px"] > 0
        found = {name: column[held] for name, column in found.items()}
    types = {"int": pa.int32(), "bigint": pa.int64()}
    return pa.table({name: pa.array(found[name]).cast(types[kind]) for name, kind in (x.split() for x in PIECE_SCHEMA.split(", "))})


def piece_statistics(r: np.ndarray, c: np.ndarray, tb: np.ndarray, r0: np.ndarray, r1: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> list[np.ndarray]:
    """Count, four sums, smallest and largest value per box, from the pixels of one tile."""
    top, left = r.min(), c.min()
    shape = (int(r.max() - top) + 1, int(c.max() - left) + 1)
    r, c = r - top, c - left
    # boxes within the part of the tile that has pixels; an empty one reads nothing
    r0, r1 = np.clip(r0 - top, 0, shape[0]), np.clip(r1 - top + 1, 0, shape[0])
    c0, c1 = np.clip(c0 - left, 0, shape[1]), np.clip(c1 - left + 1, 0, shape[1])
    r1, c1 = np.maximum(r0, r1), np.maximum(c0, c1)
    out = []
    for values in (np.ones_like(tb), tb, tb * tb, tb * (r + top), tb * (c + left)):
        table = np.zeros((shape[0] + 1, shape[1] + 1), dtype=np.int64)
        table[r + 1, c + 1] = values
        table = table.cumsum(axis=0).cumsum(axis=1)
        out.append(table[r1, c1] - table[r0, c1] - table[r1, c0] + table[r0, c0])
    for sign in (1, -1):
        grid = np.full(shape, NONE)
        grid[r, c] = sign * tb
        out.append(sign * _least(grid, r0, r1, c0, c1))
    return out


def _least(grid: np.ndarray, r0: np.ndarray, r1: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Smallest value of each box, from windows of ``2 ** i`` rows and ``2 ** j`` columns that boxes of that size need."""
    least = np.full(r0.size, NONE, dtype=np.int64)
    full = np.flatnonzero((r1 > r0) & (c1 > c0))
    high, wide = _log2(r1[full] - r0[full]), _log2(c1[full] - c0[full])
    for i, rows in _windows(grid, 0, int(high.max(initial=-1))):
        level = full[high == i]
        if not level.size:
            continue
        for j, window in _windows(rows, 1, int(wide[high == i].max())):
            these = full[(high == i) & (wide == j)]
            below, beside = r1[these] - (1 << i), c1[these] - (1 << j)
            corners = [window[a, b] for a in (r0[these], below) for b in (c0[these], beside)]
            least[these] = np.minimum.reduce(corners)
    return least


def _log2(size: np.ndarray) -> np.ndarray:
    return np.frexp(size.astype(np.float64))[1] - 1


def _windows(grid: np.ndarray, axis: int, upto: int) -> Iterator[tuple[int, np.ndarray]]:
    """Minima of windows of 1, 2, 4, ... lines along ``axis``, by their first line."""
    for i in range(upto + 1):
        if i:
            step = 1 << (i - 1)
            lines = grid.shape[axis] - step
            grid = np.minimum(grid.take(range(lines), axis), grid.take(range(step, step + lines), axis))
        yield i, grid
