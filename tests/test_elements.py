import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtrack.operators import elements, labeling
from gridtrack.operators.boxes import box_statistics
from gridtrack.operators.raster import Raster, between_times, mask_temperature, nearest_on_axis, raster_from_grid
from tests.grids import MICRO, flood_labels, micro_raster

BOXED = [[[220, 0, 210], [220, 0, 0], [220, 220, 220]]]


def noise(seed, frames=3, side=30, density=0.58):
    rnd = random.Random(seed)
    return [(f, r, c, 200 + rnd.randint(0, 40)) for f in range(1, frames + 1)
            for r in range(side) for c in range(side) if rnd.random() < density]


@pytest.mark.parametrize("tile", [4, 7, 512])
def test_labels_equal_flood_fill_for_every_tile_size(spark, tile):
    rows = noise(1)
    pixels = spark.createDataFrame(rows, "scope bigint, r int, c int, tb int")
    got = {(x.scope, x.r, x.c): (x.scope, x.label >> 32, x.label & 0xFFFFFFFF)
           for x in labeling.label_pixels(pixels, tile).collect()}
    assert got == flood_labels([row[:3] for row in rows])


def test_summary_is_the_same_for_every_tile_size(spark):
    pixels = spark.createDataFrame(noise(2), "scope bigint, r int, c int, tb int")
    small, whole = (
        {tuple(row) for row in labeling.region_summary(pixels, tile).drop("open", *labeling.BOX_SUMS).collect()} for tile in (5, 512))
    assert small == whole


@pytest.mark.parametrize("tile", [6, 11])
def test_box_statistics_do_not_depend_on_tiles(spark, tile):
    """Open regions read the tiles around them, the others have what their own tile knows."""
    pixels = spark.createDataFrame(noise(21, frames=2), "frame int, r int, c int, tb smallint")
    whole = Raster(pixels, None, None, None)
    found = []
    for size in (tile, 512):
        config = MICRO.with_options(tile=size)
        boxes = elements.element_boxes(whole, config)
        opened = {x.open for x in boxes.select("open").distinct().collect()}
        found.append({tuple(x) for x in elements.element_stats(whole, boxes, config).collect()})
        assert opened == ({0, 1} if size == tile else opened)
    assert found[0] == found[1] and len(found[0]) > 20


@pytest.mark.parametrize("tile", [4, 512])
def test_nested_thresholds_in_one_pass(spark, tile):
    """Every threshold as if it were the only one; the one below all values has no region."""
    rows = noise(12, frames=2)
    pixels = spark.createDataFrame(rows, "scope bigint, r int, c int, tb int")
    limits = (300.0, 225.0, 212.5, 100.0)
    got = {(x.scope, x.label): (x.n, x.r0, x.r1, x.c0, x.c1, x.tmin, x.tmax, x.tb_sum) for x in labeling.region_summary(pixels, tile, limits).collect()}
    want = {}
    for k, limit in enumerate(limits):
        cold = {row[:3]: row[3] for row in rows if row[3] < limit}
        regions = {}
        for point, first in flood_labels(cold).items():
            regions.setdefault(first, []).append(point)
        for (frame, r, c), points in regions.items():
            tb = [cold[p] for p in points]
            rs, cs = [p[1] for p in points], [p[2] for p in points]
            want[frame * 4 + k, r << 32 | c] = (len(points), min(rs), max(rs), min(cs), max(cs), min(tb), max(tb), sum(tb))
    assert got == want


def test_labels_move_with_the_picture(spark):
    rows = noise(3, frames=1, side=20)
    moved = [(f, r + 13, c + 7, tb) for f, r, c, tb in rows]
    schema = "scope bigint, r int, c int, tb int"
    plain, shifted = (
        {(x.r, x.c): x.label for x in labeling.label_pixels(spark.createDataFrame(d, schema), 6).collect()}
        for d in (rows, moved))
    assert {(r + 13, c + 7): label + (13 << 32) + 7 for (r, c), label in plain.items()} == shifted


def stats(spark, config):
    raster = micro_raster(spark, BOXED)
    boxes = elements.element_boxes(raster, config)
    return {row.label: row for row in elements.element_stats(raster, boxes, config).collect()}


def test_box_statistics_cover_the_box(spark):
    rows = stats(spark, MICRO)
    big, small = rows[0], rows[2]
    assert (big.n_px, big.area, big.tmin, big.tmax, big.center_r, big.center_c) == (6, 96, 210, 220, 1, 1)
    assert big.bt_avg == pytest.approx(218.333333) and big.bt_var == pytest.approx(13.888889)
    assert big.cf == pytest.approx(95.454545) and big.eccentricity == pytest.approx(0.999667, abs=1e-6)
    assert (small.n_px, small.area, small.center_r, small.center_c) == (1, 16, 0, 2)
    assert small.eccentricity == pytest.approx(0.999001, abs=1e-6)
    assert big.accepted and not small.accepted


def test_component_statistics_cover_the_region(spark):
    big = stats(spark, MICRO.with_options(element_mode="component"))[0]
    assert (big.n_px, big.area, big.tmin, big.tmax, big.bt_avg, big.bt_var, big.cf) == (5, 80, 220, 220, 220, 0, 100)


def test_acceptance_by_contrast(spark):
    config = MICRO.with_options(area_min=200, convective_fraction=0.96)
    assert stats(spark, config)[0].accepted
    assert not stats(spark, config.with_options(element_mode="component"))[0].accepted


def test_box_spanning_many_join_cells(spark):
    """An L-shaped region and a speck far inside its box: the speck counts for both."""
    side = 100
    rows = [[220 if c == 0 or r == side - 1 else 0 for c in range(side)] for r in range(side)]
    rows[10][80] = 205
    raster = micro_raster(spark, [rows])
    for tile in (16, 512):
        config = MICRO.with_options(tile=tile)
        found = elements.find_elements(raster, config)
        big = found.accepted.where("n_px > 1").first()
        assert (big.n_px, big.tmin, big.r0, big.r1, big.c0, big.c1) == (2 * side, 205, 0, side - 1, 0, side - 1)


@pytest.mark.parametrize("tile", [4, 7, 512])
def test_box_statistics_equal_a_plain_count(spark, tile):
    """Boxes of all sizes, some over many tiles, some without a pixel, some beyond the grid."""
    rnd = random.Random(11)
    rows = [(f, r + 3, c + 5, tb) for f, r, c, tb in noise(9, frames=2, side=25, density=0.3)]
    boxes = []
    for label in range(120):
        r0, c0 = rnd.randint(0, 30), rnd.randint(0, 32)
        boxes.append((1 + label % 2, label, r0, r0 + rnd.randint(0, 20), c0, c0 + rnd.randint(0, 20)))
    pixels = spark.createDataFrame(rows, "frame int, r int, c int, tb smallint")
    table = spark.createDataFrame(boxes, "frame int, label bigint, r0 int, r1 int, c0 int, c1 int")
    got = {x.label: tuple(x) for x in box_statistics(pixels, table, tile).collect()}
    want = {}
    for frame, label, r0, r1, c0, c1 in boxes:
        own = [(r, c, tb) for f, r, c, tb in rows if f == frame and r0 <= r <= r1 and c0 <= c <= c1]
        if own:
            r, c, tb = (np.array(x) for x in zip(*own))
            want[label] = (frame, label, r0, r1, c0, c1, len(own), tb.sum(), (tb * tb).sum(), (tb * r).sum(), (tb * c).sum(), tb.min(), tb.max())
    assert got == want and 0 < len(want) < 120


def test_pixels_are_shuffled_once_for_all_boxes(spark):
    """The plan has no join of pixels and boxes: rows of the cogroup are pixels and pieces."""
    pixels = spark.createDataFrame(noise(9), "frame int, r int, c int, tb smallint")
    boxes = spark.range(500).selectExpr("cast(1 + id % 3 AS int) frame", "id label", "0 r0", "29 r1", "0 c0", "29 c1")
    plan = box_statistics(pixels, boxes, 512)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 3


def test_elements_are_numbered_in_raster_order_per_frame(spark):
    frames = [[[220, 0, 220, 0], [220, 0, 220, 0], [0, 0, 0, 0], [220, 220, 220, 220]],
              [[0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0], [220, 220, 0, 0]]]
    found = elements.find_elements(micro_raster(spark, frames), MICRO.with_options(area_min=32))
    got = {(x.id, x.r0, x.c0) for x in found.accepted.collect()}
    assert got == {("F1CE1", 0, 0), ("F1CE2", 0, 2), ("F1CE3", 3, 0), ("F2CE1", 3, 0)}
    assert found.accepted.where("id = 'F1CE2'").first().center_lon == 2.0


def test_pixel_list_is_ordered_by_latitude(spark):
    raster = micro_raster(spark, BOXED)
    south_up = Raster(raster.pixels, raster.rows.withColumn("lat", -F.col("lat")), raster.cols, raster.frames)
    found = elements.find_elements(south_up, MICRO)
    rows = elements.pixel_list(found.pixels, south_up).orderBy("seq").collect()
    assert [(x.r, x.c) for x in rows] == [(2, 0), (2, 1), (2, 2), (1, 0), (0, 0), (0, 2)]


def grid(spark, rows):
    return spark.createDataFrame(rows, "frame int, t string, r int, c int, lat double, lon double, tb double").selectExpr(
        "frame", "cast(t as timestamp_ntz) ts", "r", "c", "lat", "lon", "tb")


def test_fraction_is_dropped_before_the_threshold(spark):
    values = [243.9, 244.0, 243.0, 0.4, 100.0]
    cells = grid(spark, [(1, "2009-08-31 00:00:00", 0, i, 0.0, float(i), tb) for i, tb in enumerate(values)])
    assert sorted(x.tb for x in mask_temperature(cells, MICRO).collect()) == [100, 243, 243]


def test_clip_takes_nearest_lines_and_leaves_out_the_last(spark):
    cells = grid(spark, [(1, "2009-08-31 00:00:00", r, c, 4.0 + r, 350.0 + 2 * c - (360 if c >= 5 else 0), 220.0)
                         for r in range(20) for c in range(12)])
    config = MICRO.with_options(lat_min=5.2, lat_max=8.4, lon_min=-5, lon_max=3)
    raster = raster_from_grid(cells, config)
    assert sorted(x.lat for x in raster.rows.collect()) == [5.0, 6.0, 7.0]
    lons = sorted(x.lon for x in raster.cols.collect())
    assert lons[0] >= -6 and lons[-1] < 4 and -2.0 in lons and 0.0 in lons
    assert raster.pixels.count() == 3 * len(lons)


def test_nearest_line_prefers_the_first_on_a_tie(spark):
    axis = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "r int, lat double")
    assert nearest_on_axis(axis, "r", "lat", 2.5).first().lat == 2.0


def test_empty_grid_raises(spark):
    with pytest.raises(ValueError, match="no rows"):
        raster_from_grid(grid(spark, []), MICRO)


def test_period_includes_both_ends(spark):
    cells = grid(spark, [(h, f"2009-08-31 {h:02d}:00:00", 0, 0, 0.0, 0.0, 220.0) for h in range(24)])
    config = MICRO.with_options(start="2009083103", end="200908310700")
    assert sorted(x.frame for x in between_times(cells, config).collect()) == [3, 4, 5, 6, 7]
