from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtrack.functions.histogram import histogram
from gridtrack.operators import compare, metrics, plot_data, precip, regrid
from tests.grids import MICRO


def source(spark, rows):
    """``rows``: one grid, given as rows of values along latitude."""
    data = [("2009-08-31 00:00:00", float(y), float(x), v) for y, row in enumerate(rows) for x, v in enumerate(row)]
    return spark.createDataFrame(data, "t string, lat double, lon double, value double").selectExpr(
        "cast(t as timestamp_ntz) ts", "lat", "lon", "value")


def axes(spark, lats, lons):
    return (spark.createDataFrame(list(enumerate(lats)), "r int, lat double"),
            spark.createDataFrame(list(enumerate(lons)), "c int, lon double"))


def test_bilinear_values_and_edges(spark):
    grid = regrid.coarse_grid(source(spark, [[0.0, 1.0], [2.0, 3.0]]))
    rows, cols = axes(spark, [0.0, 0.25, 0.5, 9.0], [0.0, 0.5, 0.75])
    got = {(x.r, x.c): x.value for x in regrid.regrid_bilinear(grid, rows, cols).collect()}
    assert got[2, 1] == 1.5 and got[1, 2] == 1.25 and got[0, 0] == 0.0 and got[3, 2] == 2.75
    masked = {(x.r, x.c): x.value for x in regrid.regrid_bilinear(grid, rows, cols, mask_outside=True).collect()}
    assert masked[0, 0] is None and masked[3, 2] is None and masked[2, 1] == 1.5


def test_missing_cells_take_a_neighbour_with_wrap(spark):
    cells = regrid.feather(regrid.coarse_grid(source(spark, [[-9.0, 1.0, -9.0], [2.0, -9.0, 5.0], [-9.0, 7.0, -9.0]]))).cells
    got = {(x.y, x.x): x.value for x in cells.collect()}
    # left, else above, else right, else below; the left of column 0 is column 2
    assert got[0, 2] == 1.0 and got[1, 1] == 2.0 and got[2, 2] == 7.0 and got[0, 0] == 1.0 and got[2, 0] == 2.0


def test_lonely_missing_cells_keep_their_raw_value_or_blank_the_result(spark):
    grid = regrid.coarse_grid(source(spark, [[-9.0, -9.0, -9.0, 4.0], [-9.0, -9.0, -9.0, -9.0], [-9.0, -9.0, -9.0, -9.0], [-9.0, -9.0, -9.0, -9.0]]))
    filled = {(x.y, x.x): x.value for x in regrid.feather(grid).cells.collect()}
    assert filled[1, 1] == -9.0 and filled[0, 2] == 4.0 and filled[0, 0] == 4.0
    rows, cols = axes(spark, [0.0, 1.5], [3.0, 1.5])
    strict = {(x.r, x.c): x.value for x in regrid.regrid_bilinear(grid, rows, cols, propagate_missing=True).collect()}
    assert strict[0, 0] == 4.0 and strict[1, 1] is None


def test_source_axes_are_sorted_and_folded(spark):
    flipped = source(spark, [[0.0, 1.0], [2.0, 3.0]]).withColumn("lon", F.when(F.col("lon") == 0, 359.0).otherwise(0.0))
    rows, cols = axes(spark, [0.5], [-0.5])
    assert regrid.regrid_bilinear(regrid.coarse_grid(flipped), rows, cols).first().value == 1.5


def test_cubic_passes_through_the_samples_and_is_smooth(spark):
    """Exact at the samples; far from the mirrored edges a quadratic surface is reproduced."""
    def surface(y, x):
        return 1 + 0.3 * y * y + 0.5 * x - 0.01 * x * y

    lines = [float(i) for i in range(18)]
    grid = regrid.coarse_grid(source(spark, [[surface(y, x) for x in lines] for y in lines]))
    exact = {(x.r, x.c): x.value for x in regrid.regrid_cubic(grid, *axes(spark, lines, lines)).collect()}
    assert exact == {(y, x): pytest.approx(surface(y, x)) for y in range(18) for x in range(18)}
    fine = {x.c: x.value for x in regrid.regrid_cubic(grid, *axes(spark, [8.5], [8.5, 9.25])).collect()}
    assert [fine[0], fine[1]] == pytest.approx([surface(8.5, 8.5), surface(8.5, 9.25)], abs=1e-3)


def test_spline_coefficients_solve_the_mirrored_system():
    samples = np.array([3.0, -1.0, 4.0, 1.0, 5.0])
    c = regrid.spline_coefficients(samples)
    padded = np.r_[c[1], c, c[-2]]
    assert (padded[:-2] + 4 * padded[1:-1] + padded[2:]) / 6 == pytest.approx(samples)


def elements_table(spark):
    return spark.createDataFrame([(1, 1, 100.0), (1, 2, 50.0)], "frame int, ce_no int, area double")


def test_attached_rain_and_set_once(spark):
    rain = spark.createDataFrame([(1, 1, 0, 0, 2.0), (1, 1, 0, 1, 3.0)], "frame int, ce_no int, r int, c int, rain double")
    wet = precip.attach_rain(elements_table(spark), rain, MICRO)
    got = {x.ce_no: (x.precip_total, x.precip_area, x.precip_max, x.precip_min) for x in wet.collect()}
    assert got == {1: (5.0, 32.0, 3.0, 2.0), 2: (0.0, 0.0, 0.0, 0.0)}
    again = precip.attach_rain(wet, rain.withColumn("rain", F.col("rain") * 10), MICRO)
    assert {x.ce_no: x.precip_total for x in again.collect()} == {1: 5.0, 2: 0.0}


def nodes(spark, rows):
    """``rows``: (feature, frame, ce_no, hour, area, rain, stage)."""
    data = [("MCC", f, i, frame, ce, f"F{frame}CE{ce}", f"2009-08-31 {hour:02d}:00:00", area, rain, stage, frame << 32 | ce)
            for i, (f, frame, ce, hour, area, rain, stage) in enumerate(rows, 1)]
    return spark.createDataFrame(data, "kind string, feature_id bigint, seq int, frame int, ce_no int, id string, t string, "
                                 "area double, precip_total double, stage string, node bigint").select(
        "*", F.col("t").cast("timestamp_ntz").alias("ts"), F.lit(0.8).alias("eccentricity"),
        F.col("frame").cast("double").alias("center_lat"), F.lit(2.0).alias("center_lon"),
        (F.col("area") / 2).alias("precip_area"), (F.col("precip_total") / 2).alias("precip_max"),
        (F.col("precip_total") / 4).alias("precip_min"))


def test_runs_of_equal_hours(spark):
    table = nodes(spark, [(1, 1, 1, 3, 1.0, 1.0, "I"), (1, 2, 1, 3, 1.0, 2.0, "M"), (1, 3, 1, 4, 1.0, 5.0, "M"), (1, 4, 1, 3, 1.0, 1.0, "D")])
    got = [(x.hour, x.rain) for x in metrics.precip_totals(table).orderBy("run").collect()]
    assert got == [(3, 3.0), (4, 5.0), (3, 1.0), (None, 9.0)]


def test_durations_with_one_frame_features(spark):
    table = nodes(spark, [(1, 1, 1, 3, 1.0, 0.0, "M"), (1, 2, 1, 4, 1.0, 0.0, "M"), (1, 2, 2, 4, 1.0, 0.0, "M"), (2, 9, 1, 9, 1.0, 0.0, "M")])
    info = {x.feature_id: (x.n_times, x.duration_sec) for x in metrics.temporal_info(table).collect()}
    assert info == {1: (2, 7200), 2: (1, None)}
    total = metrics.duration_summary(metrics.temporal_info(table)).first()
    assert (total.avg_duration_sec, total.n_features) == (7200.0, 2)


def test_average_size_is_not_weighted_by_members(spark):
    table = nodes(spark, [(1, 1, 1, 1, 10.0, 0.0, "M"), (1, 2, 1, 2, 30.0, 0.0, "M"), (2, 1, 2, 1, 100.0, 0.0, "M")])
    assert metrics.average_feature_size(table).first().avg_size == 60.0


def test_feature_report_uses_mature_members(spark):
    table = nodes(spark, [(1, 1, 1, 1, 100.0, 0.0, "I"), (1, 2, 1, 2, 300.0, 8.0, "M"), (1, 3, 1, 3, 300.0, 4.0, "M"), (1, 4, 1, 4, 50.0, 2.0, None)])
    row = metrics.feature_report(table, MICRO).first()
    assert (row.start, row.end, row.duration_hours) == (datetime(2009, 8, 31, 1), datetime(2009, 8, 31, 4), 4.0)
    assert (row.mature_hours, row.avg_area, row.max_area, row.max_area_ts) == (2.0, 300.0, 300.0, datetime(2009, 8, 31, 2))
    assert (row.precip_total, row.avg_precip, row.max_rate, row.min_rate) == (14.0, pytest.approx(14 / 3), 4.0, 0.0)
    assert row.avg_max_rate == pytest.approx((4 + 2 + 1) / 3) and row.precip_area_pct == 50.0
    summary = metrics.summary_report(table, MICRO).first()
    assert (summary.n_features, summary.avg_duration_hours, summary.avg_start) == (1, 4.0, "01:00:00")


def test_speed_is_the_slope_of_the_displacement(spark):
    table = nodes(spark, [(1, 1, 1, 1, 1.0, 0.0, "M"), (1, 3, 1, 2, 1.0, 0.0, "M"), (2, 5, 5, 1, 1.0, 0.0, "M")])
    edges = spark.createDataFrame([(1 << 32 | 1, 3 << 32 | 1)], "src bigint, dst bigint")
    got = {x.id: x.speed for x in metrics.element_speed(table, edges, MICRO).collect()}
    assert got == {"F1CE1": pytest.approx(2 * 111 * 1000 / 3600), "F3CE1": pytest.approx(2 * 111 * 1000 / 3600), "F5CE5": 0.0}


@pytest.mark.parametrize("values, bins", [([1.0, 2.0, 2.0, 5.0, 11.0], 5), ([3.0, 3.0], 10), ([0.1 * i for i in range(50)], 7)])
def test_histogram_equals_numpy(spark, values, bins):
    got = histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", bins).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins)
    assert [x.n for x in got] == counts.tolist()
    assert [x.low for x in got] == pytest.approx(edges[:-1].tolist())
    assert sum(x.share for x in got) == pytest.approx(1.0)


def test_figure_data(spark):
    table = nodes(spark, [(1, 1, 1, 1, 79999.0, 1.0, "M"), (1, 2, 1, 2, 80000.0, 1.0, "M"), (1, 3, 1, 3, 160000.0, 1.0, "M")])
    assert [x.size_class for x in plot_data.size_points(table).orderBy("ts").collect()] == ["small", "medium", "large"]
    limits = plot_data.size_limits(table).first()
    assert (limits.from_ts, limits.to_ts, limits.max_area) == (datetime(2009, 8, 31, 0), datetime(2009, 8, 31, 4), 161000.0)
    assert {x.label for x in plot_data.precip_points(table).collect()} == {"50%"}
    rain = spark.createDataFrame([(1, 1, 0, 0, 2.0), (2, 1, 0, 0, 3.0), (3, 1, 5, 5, 1.0)], "frame int, ce_no int, r int, c int, rain double")
    assert {(x.r, x.rain) for x in plot_data.rain_per_feature(table, rain).collect()} == {(0, 5.0), (5, 1.0)}
    frames = table.select("frame", "ts")
    summed = plot_data.rain_in_range(rain, frames, "2009-08-31_01:00:00", "2009-08-31_02:30:00", 0.5)
    assert [(x.r, x.rain) for x in summed.collect()] == [(0, 5.0)]
    late = plot_data.rain_in_range(rain, frames, "2009-09-02_01:00:00", "2009-09-02_02:00:00", 1)
    assert late.isEmpty()


def test_comparison_reports_both_sides(spark):
    schema = "frame int, ce_no int, r int, c int, tb int"
    left = spark.createDataFrame([(1, 1, 0, 0, 210), (1, 1, 0, 1, 220), (1, 2, 5, 5, 200)], schema)
    right = spark.createDataFrame([(1, 1, 0, 0, 210), (1, 1, 0, 1, 225), (2, 1, 0, 0, 200)], schema)
    keys = {(x.frame, x.ce_no, x.only_in) for x in compare.only_in_one(left, right, ["frame", "ce_no"]).collect()}
    assert keys == {(1, 2, "left"), (2, 1, "right")}
    got = {(x.frame, x.ce_no): (x.n_different, x.max_difference) for x in compare.compare_elements(left, right).collect()}
    assert got == {(1, 1): (1, 5), (1, 2): (1, 200), (2, 1): (1, 200)}
    assert compare.compare_elements(left, left).where("n_different > 0").isEmpty()
