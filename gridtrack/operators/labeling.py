"""Connected regions of a raster (4-neighbour cross), frame size notwithstanding.

A plane (``scope``) is cut into square tiles.  Each tile is one group, so no
group holds more than ``tile * tile`` pixels even if one frame holds most of
the data.  The grouped kernel labels its tile and hands out per-region sums
plus the pixels along the seams; regions that meet at a seam are merged by the
distributed component operator.  A region's label is the raster position of
its first pixel, so label order is raster order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtrack.operators.boxes import piece_statistics
from gridtrack.operators.components import components
from gridtrack.operators.unionfind import smallest_members
from gridtrack.session import ship_package, stage

REGION, INNER_SEAM, OUTER_SEAM, PIXEL = 0, 1, 2, 3

TILE_SCHEMA = (
    "kind int, scope bigint, label bigint, r int, c int, tb smallint, "
    "r0 int, r1 int, c0 int, c1 int, n bigint, tmin smallint, tmax smallint, "
    "tb_sum bigint, tb_sq bigint, tb_r bigint, tb_c bigint, open int, "
    "box_n bigint, box_sum bigint, box_sq bigint, box_r bigint, box_c bigint, box_min int, box_max int"
)
SUMS = ("n", "tb_sum", "tb_sq", "tb_r", "tb_c")
#: statistics of all pixels in a region's box, known to its tile unless the region is open: it may go on beyond a seam
BOX_SUMS = ("box_n", "box_sum", "box_sq", "box_r", "box_c", "box_min", "box_max")


def raster_position(r: Column | str, c: Column | str) -> Column:
    """Raster-ordered pixel number: row in the high half, column in the low half."""
    row, col = (F.col(x) if isinstance(x, str) else x for x in (r, c))
    return F.shiftleft(row.cast("bigint"), 32).bitwiseOR(col.cast("bigint"))


def region_summary(pixels: DataFrame, tile: int, thresholds: tuple[float, ...] | None = None) -> DataFrame:
    """One row per region of ``pixels(scope, r, c, tb)``: label, box, sums, and the sums of all pixels in the box.

    The latter hold for regions that are not ``open`` to other tiles.  With ``thresholds`` regions below each of them are found in the same pass: pixels
    are shuffled once however many there are, seams of all are merged together, and
    the scope of a region is ``scope * len(thresholds) + place of its threshold``; sums of boxes
    are not made then.
    """
    tiles = stage(_label_tiles(pixels, tile, False, thresholds), "tiles")
    parts = tiles.where(F.col("kind") == REGION)
    merged = _merged_labels(tiles)
    if merged is not None:
        parts = _relabel(parts, merged)
    return parts.groupBy("scope", "label").agg(
        F.min("r0").alias("r0"), F.max("r1").alias("r1"),
        F.min("c0").alias("c0"), F.max("c1").alias("c1"),
        F.min("tmin").alias("tmin"), F.max("tmax").alias("tmax"),
        *[F.sum(x).alias(x) for x in SUMS], F.max("open").alias("open"), *[F.max(x).alias(x) for x in BOX_SUMS],
    )


def label_pixels(pixels: DataFrame, tile: int) -> DataFrame:
    """``pixels(scope, r, c, tb)`` with the label of the region each belongs to."""
    tiles = stage(_label_tiles(pixels, tile, with_pixels=True), "tiles")
    rows = tiles.where(F.col("kind") == PIXEL)
    merged = _merged_labels(tiles)
    if merged is not None:
        rows = _relabel(rows, merged)
    return rows.select("scope", "r", "c", "tb", "label")


def _label_tiles(pixels: DataFrame, tile: int, with_pixels: bool, thresholds: tuple[float, ...] | None = None) -> DataFrame:
    ship_package(pixels.sparkSession)
    return (
        pixels.select(
            F.expr(f"r div {tile}").alias("tr"), F.expr(f"c div {tile}").alias("tc"),
            F.col("scope").cast("bigint").alias("scope"),
            F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"),
            F.col("tb").cast("smallint").alias("tb"),
        )
        .groupBy("scope", "tr", "tc")
        .applyInArrow(_tile_kernel(tile, with_pixels, thresholds), TILE_SCHEMA)
    )


def _merged_labels(tiles: DataFrame) -> DataFrame | None:
    """Labels that change because their regions continue in another tile."""
    outer = tiles.where(F.col("kind") == OUTER_SEAM).select("scope", "r", "c", F.col("label").alias("a"))
    inner = tiles.where(F.col("kind") == INNER_SEAM).select("scope", "r", "c", F.col("label").alias("b"))
    edges = stage(outer.join(inner, ["scope", "r", "c"]).select("scope", "a", "b").distinct(), "seams")
    if edges.isEmpty():
        return None
    return components(edges).select("scope", F.col("node").alias("label"), "root")


def _relabel(rows: DataFrame, merged: DataFrame) -> DataFrame:
    return (
        rows.join(merged, ["scope", "label"], "left")
        .withColumn("label", F.coalesce("root", "label")).drop("root")
    )


def neighbour_roots(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For pixels in raster order, the index of the first pixel of each one's region."""
    top, left = r.min(), c.min()
    index = np.full((r.max() - top + 1, c.max() - left + 1), -1, dtype=np.int64)
    index[r - top, c - left] = np.arange(r.size)
    beside = (index[:, :-1] >= 0) & (index[:, 1:] >= 0)
    below = (index[:-1] >= 0) & (index[1:] >= 0)
    first = np.concatenate([index[:, :-1][beside], index[:-1][below]])
    second = np.concatenate([index[:, 1:][beside], index[1:][below]])
    return smallest_members(r.size, first, second)


def _tile_kernel(tile: int, with_pixels: bool, thresholds: tuple[float, ...] | None):
    def label_tile(key: tuple, pixels: pa.Table) -> pa.Table:
        scope = key[0].as_py()
        r, c, tb = (pixels.column(name).to_numpy().astype(np.int64) for name in ("r", "c", "tb"))
        order = np.lexsort((c, r))
        r, c, tb = r[order], c[order], tb[order]
        if thresholds is None:
            return label(scope, r, c, tb)
        levels = [(scope * len(thresholds) + k, tb < limit) for k, limit in enumerate(thresholds)]
        found = [label(level, r[cold], c[cold], tb[cold]) for level, cold in levels if cold.any()]
        return pa.concat_tables(found) if found else TILE_TYPES.empty_table()

    def label(scope: int, r: np.ndarray, c: np.ndarray, tb: np.ndarray) -> pa.Table:
        roots = neighbour_roots(r, c)
        position = (r << 32) | c
        labels = position[roots]
        firsts, member = np.unique(roots, return_inverse=True)

        def lowest(values):
            out = np.full(firsts.size, np.iinfo(np.int64).max)
            np.minimum.at(out, member, values)
            return out

        def total(values):
            out = np.zeros(firsts.size, dtype=np.int64)
            np.add.at(out, member, values)
            return out

        regions = {
            "label": position[firsts],
            "r0": lowest(r), "r1": -lowest(-r), "c0": lowest(c), "c1": -lowest(-c),
            "n": total(1), "tmin": lowest(tb), "tmax": -lowest(-tb),
            "tb_sum": total(tb), "tb_sq": total(tb * tb), "tb_r": total(tb * r), "tb_c": total(tb * c),
        }
        if not with_pixels and thresholds is None:
            seam = (r % tile == 0) | (c % tile == 0) | (r % tile == tile - 1) | (c % tile == tile - 1)
            box = piece_statistics(r, c, tb, *(regions[x] for x in ("r0", "r1", "c0", "c1")))
            regions |= {"open": np.bincount(member[seam], minlength=firsts.size).clip(0, 1), **dict(zip(BOX_SUMS, box))}
        entry = ((r % tile == 0) & (r > 0)) | ((c % tile == 0) & (c > 0))
        east, south = c % tile == tile - 1, r % tile == tile - 1
        pieces = [
            (REGION, regions),
            (INNER_SEAM, {"label": labels[entry], "r": r[entry], "c": c[entry]}),
            (OUTER_SEAM, {"label": labels[east], "r": r[east], "c": c[east] + 1}),
            (OUTER_SEAM, {"label": labels[south], "r": r[south] + 1, "c": c[south]}),
        ]
        if with_pixels:
            pieces.append((PIXEL, {"label": labels, "r": r, "c": c, "tb": tb}))
        return _table(scope, pieces)

    return label_tile


TILE_TYPES = pa.schema([
    (name, {"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16()}[kind])
    for name, kind in (item.split() for item in TILE_SCHEMA.split(", "))
])


def _table(scope: int, pieces: list[tuple[int, dict[str, np.ndarray]]]) -> pa.Table:
    """The pieces below each other; a column that a kind of row does not have is 0."""
    pieces = [(kind, columns) for kind, columns in pieces if columns["label"].size]
    sizes = [columns["label"].size for _, columns in pieces]
    filled = {"kind": np.repeat([kind for kind, _ in pieces], sizes), "scope": np.full(sum(sizes), scope)}
    for name in TILE_TYPES.names[2:]:
        filled[name] = np.concatenate([
            columns[name] if name in columns else np.zeros(size, dtype=np.int64)
            for (_, columns), size in zip(pieces, sizes)])
    return pa.table(
        [pa.array(filled[field.name].astype(field.type.to_pandas_dtype())) for field in TILE_TYPES],
        schema=TILE_TYPES)
