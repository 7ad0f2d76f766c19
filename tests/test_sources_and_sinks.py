import json
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from gridtrack.operators.elements import find_elements
from gridtrack.operators.raster import raster_from_grid
from gridtrack.plans import pipeline
from gridtrack.sinks import stored, tables
from gridtrack.sources import files, gridfiles
from gridtrack.streaming.ingest import stream_elements
from tests.grids import MICRO, micro_raster


def classic_file(path, values, lat, lon, offset, units="hours since 2009-08-31 00", variable="ch4"):
    """Write a CDF-1 file with one unlimited dimension."""
    def text(s):
        data = s.encode()
        return struct.pack(">i", len(data)) + data + b"\0" * (-len(data) % 4)

    def attrs(**items):
        out = struct.pack(">ii", 12 if items else 0, len(items))
        for name, value in items.items():
            data = value.encode()
            out += text(name) + struct.pack(">ii", 2, len(data)) + data + b"\0" * (-len(data) % 4)
        return out

    nt, ny, nx = values.shape
    specs = [("latitude", [1], 6, ny * 8), ("longitude", [2], 6, nx * 8), ("time", [0], 6, 8),
             (variable, [0, 1, 2], 3, ny * nx * 2 + -(ny * nx * 2) % 4)]

    def header(begins):
        out = b"CDF\x01" + struct.pack(">i", nt) + struct.pack(">ii", 10, 3)
        for name, size in (("time", 0), ("lat", ny), ("lon", nx)):
            out += text(name) + struct.pack(">i", size)
        out += attrs() + struct.pack(">ii", 11, len(specs))
        for (name, dims, code, size), begin in zip(specs, begins):
            out += text(name) + struct.pack(">i", len(dims)) + b"".join(struct.pack(">i", d) for d in dims)
            out += attrs(units=units) if name == "time" else attrs()
            out += struct.pack(">iii", code, size, begin)
        return out

    start = len(header([0] * 4))
    begins = [start, start + ny * 8, start + ny * 8 + nx * 8, start + ny * 8 + nx * 8 + 8]
    body = lat.astype(">f8").tobytes() + lon.astype(">f8").tobytes()
    for t in range(nt):
        cells = values[t].astype(">i2").tobytes()
        body += struct.pack(">d", offset + t) + cells + b"\0" * (-len(cells) % 4)
    path.write_bytes(header(begins) + body)


def test_classic_netcdf_files_become_a_grid(spark, tmp_path):
    lat, lon = np.arange(3) + 5.0, np.array([358.0, 359.0, 0.0, 1.0, 2.0])
    first = np.arange(30).reshape(2, 3, 5) + 230
    classic_file(tmp_path / "a.nc", first, lat, lon, 4)
    classic_file(tmp_path / "b.nc", first[:1] + 1, lat, lon, 6)
    (tmp_path / "c.nc").write_bytes(b"broken")
    read = gridfiles.read_grid_files(spark, str(tmp_path), value_max=243)
    assert [x.file.rsplit("/", 1)[1] for x in read.bad_files.collect()] == ["c.nc"]
    assert sorted(x.frame for x in read.frames.collect()) == [1, 2, 3]
    assert [x.lon for x in read.cols.orderBy("c").collect()] == [-2.0, -1.0, 0.0, 1.0, 2.0]
    assert [x.lat for x in read.rows.orderBy("r").collect()] == [5.0, 6.0, 7.0]
    rows = read.grid.collect()
    assert len(rows) == 14 + 13
    assert {(x.frame, x.ts) for x in rows} == {(1, datetime(2009, 8, 31, 4)), (3, datetime(2009, 8, 31, 6))}
    assert {x.lon for x in rows} == {-2.0, -1.0, 0.0, 1.0, 2.0}
    at = next(x for x in rows if (x.frame, x.r, x.c) == (1, 1, 2))
    assert (at.tb, at.lat, at.lon) == (237.0, 6.0, 0.0)


def test_raw_infrared_file(spark, tmp_path):
    cells = np.full((gridfiles.RAW_ROWS, gridfiles.RAW_COLUMNS), 255, np.uint8)
    cells[0, 0], cells[-1, 10], cells[5, 7] = 125, 100, 200
    (tmp_path / "merg_2009083105_4km").write_bytes(cells.tobytes())
    read = gridfiles.read_grid_files(spark, str(tmp_path), format="merg", value_max=250)
    got = {(x.r, x.c): (x.tb, x.ts) for x in read.grid.collect()}
    hour = datetime(2009, 8, 31, 5)
    assert got == {(gridfiles.RAW_ROWS - 1, 0): (200.0, hour), (0, 10): (175.0, hour)}
    assert read.bad_files.isEmpty()


def counted(monkeypatch):
    """Files whose headers are opened, and bands that are read, in this process."""
    opened, decoded = [], []
    whole, rows = gridfiles._open_netcdf, gridfiles._Classic.rows
    monkeypatch.setattr(gridfiles, "_open_netcdf", lambda file, *names: opened.append(file.rsplit("/", 1)[1]) or whole(file, *names))
    monkeypatch.setattr(gridfiles._Classic, "rows", lambda self, t, first, last: decoded.append((t, first, last)) or rows(self, t, first, last))
    return opened, decoded


def read_all(reader):
    return [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]


def test_filters_decide_what_is_opened_and_read(tmp_path, monkeypatch):
    for day in (29, 30, 31):
        classic_file(tmp_path / f"merg_200908{day}00_4km.nc", np.full((30, 3, 4), 230), np.arange(3.0), np.arange(4.0), 0,
                     units=f"hours since 2009-08-{day} 00")
    opened, decoded = counted(monkeypatch)

    def reader(*filters, **options):
        opened.clear()
        decoded.clear()
        made = gridfiles.PushedNetcdfReader({"path": str(tmp_path)} | options)
        assert list(made.pushFilters(list(filters))) == list(filters)
        return made

    late, early = GreaterThanOrEqual(("ts",), datetime(2009, 8, 30, 12)), LessThan(("ts",), datetime(2009, 8, 30, 18))
    rows = read_all(reader(EqualTo(("kind",), "cell"), late, early, GreaterThan(("lat",), 0.5), LessThanOrEqual(("lat",), 1.0)))
    # the first file begins a day before and may last: its header is opened; the last one begins too late
    assert opened == ["merg_2009082900_4km.nc", "merg_2009083000_4km.nc"]
    assert decoded == [(t, 1, 2) for t in range(12, 18)] and {row["r"] for row in rows} == {1} and len(rows) == 24
    assert {row["kind"] for row in rows} == {"cell"} and len({row["ts"] for row in rows}) == 6
    # a file longer than a day is not lost
    rows = read_all(reader(EqualTo(("kind",), "cell"), GreaterThanOrEqual(("ts",), datetime(2009, 8, 30, 3)), LessThan(("ts",), datetime(2009, 8, 30, 4))))
    assert {row["file"].rsplit("/", 1)[1] for row in rows} == {"merg_2009082900_4km.nc", "merg_2009083000_4km.nc"}
    # without cells only headers are read; without a match in the list no header either
    heads = read_all(reader(In(("kind",), ("slice", "axis", "error"))))
    assert len(opened) == 3 and not decoded and sum(row["kind"] == "slice" for row in heads) == 90
    assert read_all(reader(EqualTo(("file",), "nowhere"))) == [] and not opened
    assert read_all(reader(EqualTo(("value",), 231.0))) and len(decoded) == 90
    read_all(reader(named_from="2009083000", named_until="2009083023"))
    assert opened == ["merg_2009083000_4km.nc"]


def test_a_plain_where_reaches_the_source(spark, tmp_path):
    for day in (30, 31):
        classic_file(tmp_path / f"merg_200908{day}00_4km.nc", np.arange(24).reshape(2, 3, 4) + 230, np.arange(3.0), np.arange(4.0), 0,
                     units=f"hours since 2009-08-{day} 00")
    (tmp_path / "merg_2009090100_4km.nc").write_bytes(b"never opened")
    with gridfiles.pushing(spark):
        rows = gridfiles.open_files(spark, str(tmp_path))
        day = F.lit("2009-08-30 23:00:00").cast("timestamp_ntz")
        found = rows.where((F.col("kind") == "cell") & (F.col("ts") < day) & (F.col("lat") >= 1) & (F.col("value") < 245))
        assert sorted((x.t, x.r, x.c, x.value) for x in found.collect()) == [
            (t, r, c, 230.0 + 12 * t + 4 * r + c) for t in range(2) for r in (1, 2) for c in range(4) if 12 * t + 4 * r + c < 15]
        assert found.rdd.getNumPartitions() == 1  # of three files
        assert rows.where("kind = 'error'").count() == 1
        every = rows.where("kind = 'cell' AND value BETWEEN 231 AND 233 AND t IN (0, 5)").collect()
    assert sorted(every) == sorted(gridfiles.open_files(spark, str(tmp_path)).where("kind = 'cell' AND value BETWEEN 231 AND 233 AND t IN (0, 5)").collect())


@pytest.mark.parametrize("split", [1 << 30, 3000, 100])
def test_parts_of_a_file_give_the_same_rows(tmp_path, monkeypatch, split):
    """A long file is many tasks, of whole slices or of bands of rows."""
    monkeypatch.setattr(gridfiles, "BAND", 2)
    values = np.random.default_rng(1).integers(200, 300, (40, 5, 4))
    classic_file(tmp_path / "year_20090101.nc", values, np.arange(5.0), np.arange(4.0), 0)
    size = (tmp_path / "year_20090101.nc").stat().st_size
    reader = gridfiles.NetcdfReader({"path": str(tmp_path), "split_bytes": str(split)})
    assert len(reader.partitions()) == -(-size // split)
    rows = read_all(reader)
    cells = {(x["t"], x["r"], x["c"]): x["value"] for x in rows if x["kind"] == "cell"}
    assert cells == {(t, r, c): float(v) for (t, r, c), v in np.ndenumerate(values)}
    assert sum(x["kind"] == "cell" for x in rows) == values.size
    assert sorted(x["t"] for x in rows if x["kind"] == "slice") == list(range(40))
    assert sum(x["kind"] == "axis" for x in rows) == 9


def test_raw_files_are_split_by_bands(tmp_path, monkeypatch):
    monkeypatch.setattr(gridfiles, "RAW_ROWS", 600)
    monkeypatch.setattr(gridfiles, "RAW_COLUMNS", 8)
    raw = np.random.default_rng(2).integers(0, 254, (2, 600, 8)).astype(np.uint8)
    (tmp_path / "merg_2009083105_4km").write_bytes(raw.tobytes())
    reader = gridfiles.RawReader({"path": str(tmp_path), "split_bytes": "2000"})
    assert len(reader.partitions()) == 5
    rows = read_all(reader)
    got = {(x["t"], x["r"], x["c"]): x["value"] for x in rows if x["kind"] == "cell"}
    assert got == {(t, r, c): float(v) + 75 for (t, r, c), v in np.ndenumerate(raw[:, ::-1])}
    assert sorted(x["ts"] for x in rows if x["kind"] == "slice") == [datetime(2009, 8, 31, 5), datetime(2009, 8, 31, 5, 30)]


def test_a_slice_that_breaks_off_is_an_error(tmp_path, monkeypatch):
    """Whatever task reads a part of it: no cell of the slice passes."""
    monkeypatch.setattr(gridfiles, "BAND", 1)
    file = tmp_path / "merg_2009083105_4km.nc"
    classic_file(file, np.full((3, 6, 4), 230), np.arange(6.0), np.arange(4.0), 0)
    file.write_bytes(file.read_bytes()[:-20])
    for split in ("100", "100000"):
        rows = read_all(gridfiles.NetcdfReader({"path": str(tmp_path), "split_bytes": split}))
        assert {x["t"] for x in rows if x["kind"] == "cell"} == {0, 1} == {x["t"] for x in rows if x["kind"] == "slice"}
        assert [x["error"][:7] for x in rows if x["kind"] == "error"] == ["slice 2"]
    # what fails while cells are read fails the task
    monkeypatch.setattr(gridfiles._Classic, "rows", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        read_all(gridfiles.NetcdfReader({"path": str(tmp_path)}))


def test_a_file_of_many_days_counts_whole(spark, tmp_path):
    """A month in one file: the period lies far behind the time in the file's name."""
    classic_file(tmp_path / "merg_2009080100_month.nc", np.arange(31)[:, None, None] + np.full((31, 2, 2), 200), np.arange(2.0), np.arange(2.0), 0,
                 units="days since 2009-08-01 00")
    read = gridfiles.read_grid_files(spark, str(tmp_path), start="2009082500", end="2009082700")
    assert sorted(x.ts.day for x in read.frames.collect()) == [25, 26, 27] and read.n_files == 1
    assert sorted({(x.frame, x.tb) for x in read.grid.collect()}) == [(1, 224.0), (2, 225.0), (3, 226.0)]
    promised = gridfiles.read_grid_files(spark, str(tmp_path), start="2009082500", end="2009082700", file_hours=24 * 31)
    assert promised.frames.count() == 3


def test_times_of_headers_are_those_of_the_column(spark):
    from gridtrack.functions import dates

    bases = ["2009-08-31 00:00:00", "2009-08-31 06:30", "2009-12-31 2350", "2008-02-29 00", "2009-08-31", " 2009-08-31 00:00:00.0", "2009-8-1 00", "soon", ""]
    rows = [(f"{unit} since {base}", x) for unit in ("minutes", "hours", "days", "months", "years", "weeks")
            for base in bases for x in (0.0, 1.0, 13.0, -5.0, 0.5, 1.25, 36.1)] + [("hours", 1.0), ("", 1.0)]
    table = spark.createDataFrame(rows, "units string, x double").select("units", "x", dates.decode_model_time("units", "x").alias("ts"))
    for r in table.collect():
        assert dates.model_time(r.units, r.x) == r.ts, (r.units, r.x)


def test_half_hourly_slices_and_doubled_times(spark, tmp_path):
    lat, lon, values = np.arange(3.0), np.arange(4.0), np.full((1, 3, 4), 230)
    classic_file(tmp_path / "a.nc", values, lat, lon, 4)
    classic_file(tmp_path / "b.nc", values, lat, lon, 4.5)
    read = gridfiles.read_grid_files(spark, str(tmp_path))
    assert sorted(x.ts for x in read.frames.collect()) == [datetime(2009, 8, 31, 4), datetime(2009, 8, 31, 4, 30)]
    assert read.step_class == "hourly"
    classic_file(tmp_path / "c.nc", values, lat, lon, 4.5)
    with pytest.raises(ValueError, match="2 slices have the time"):
        gridfiles.read_grid_files(spark, str(tmp_path))


def test_unknown_time_steps_are_refused(spark, tmp_path):
    for name, hour in (("a.nc", 0), ("b.nc", 5)):
        classic_file(tmp_path / name, np.full((1, 3, 4), 230), np.arange(3.0), np.arange(4.0), hour)
    with pytest.raises(ValueError, match="time step not supported"):
        gridfiles.read_grid_files(spark, str(tmp_path))


def test_no_files_raise(spark, tmp_path):
    with pytest.raises(Exception, match="no grid files"):
        gridfiles.read_grid_files(spark, str(tmp_path))


def test_missing_times(spark, tmp_path):
    for name in ("3B42.20090831.00.7A.nc", "3B42.20090831.06.7A.nc", "notes.nc"):
        (tmp_path / name).write_bytes(b"x")
    start, end = datetime(2009, 8, 31, 0), datetime(2009, 8, 31, 6)
    present, missing = files.check_files(spark, str(tmp_path), start, end, 3)
    assert {x.name for x in present.collect()} == {"3B42.20090831.00.7A.nc", "3B42.20090831.06.7A.nc"}
    assert [x.ts for x in missing.collect()] == [datetime(2009, 8, 31, 3)]


@pytest.mark.parametrize("name, ts", [
    ("merg_2009083105_4km-pixel.nc", datetime(2009, 8, 31, 5)), ("3B42.20090831.21.7A.nc", datetime(2009, 8, 31, 21)),
    ("x_20090831_0530.nc", datetime(2009, 8, 31, 5, 30)), ("rain200908.nc", datetime(2009, 8, 1)), ("a.nc", None),
])
def test_times_in_file_names(spark, name, ts):
    assert spark.range(1).select(files.file_time(F.lit(name)).alias("x")).first().x == ts


def moving_blocks(frames=4):
    out = []
    for f in range(frames):
        rows = [[0] * 12 for _ in range(8)]
        for r in range(1, 6):
            for c in range(1 + f, 7 + f):
                rows[r][c] = 205 if 2 <= r <= 4 and 2 + f <= c <= 5 + f else 225
        out.append(rows)
    return out


def test_products_of_a_run(spark, tmp_path):
    config = MICRO.with_options(output_dir=str(tmp_path / "out"), outer_area=300, inner_area=100, minimum_duration=3)
    raster = micro_raster(spark, moving_blocks())
    source = spark.createDataFrame(
        [("2009-08-31 00:00:00", float(a), float(b), 2.0) for a in (0, 4, 8) for b in (0, 6, 12)],
        "t string, lat double, lon double, value double").selectExpr("cast(t as timestamp_ntz) ts", "lat", "lon", "value")
    timings = {}
    run = pipeline.analyse(raster, config, source.unionByName(source.withColumn("ts", F.expr("ts + interval '3' hour"))), timings)
    tables.write_products(run, config, timings)
    out = tmp_path / "out"
    record = json.loads(spark.read.text(str(out / "run.json")).first().value)
    assert (record["elements"], record["graph_edges"], record["mcs"], record["mcc"]) == (4, 3, 1, 1)
    lines = "\n".join(x.value for x in spark.read.text(str(out / "reports/cluster_paths")).collect())
    assert all(f"Subtree pathlength is 9 and step {i} of F1CE1 is F{i}CE1" in lines for i in range(1, 5))
    graph = [json.loads(x.value) for x in spark.read.text(str(out / "reports/graph_json")).collect()]
    assert {(g["cloudElement"], tuple(g["edges"])) for g in graph} == {
        ("F2CE1", ("F1CE1",)), ("F3CE1", ("F2CE1",)), ("F4CE1", ("F3CE1",))}
    report = "\n".join(x.value for x in spark.read.text(str(out / "reports/features")).collect())
    assert "Max area is: 480.0000 km^2" in report and "Total precipitation during MCS is: 240.0000 mm/lifetime" in report
    assert spark.read.parquet(str(out / "element_grids")).count() == 120
    assert spark.read.parquet(str(out / "rain_per_feature")).count() > 0
    assert spark.read.parquet(str(out / "rain_total")).count() > 0
    other = pipeline.analyse(micro_raster(spark, [[[tb - 3 if tb == 205 and f == 2 else tb for tb in row] for row in rows]
                                                  for f, rows in enumerate(moving_blocks()[:3])]), config)
    tables.write_products(other, config.with_options(output_dir=str(tmp_path / "other")))
    for name, right in (("same", "out"), ("changed", "other")):
        tables.write_differences(spark, str(out), str(tmp_path / right), str(tmp_path / name))
    assert all(spark.read.parquet(str(tmp_path / f"same/{x}")).isEmpty() for x in ("cells", "elements", "nodes"))
    changed = {(x.frame, x.n_different, x.max_difference) for x in spark.read.parquet(str(tmp_path / "changed/cells")).collect()}
    assert changed == {(3, 12, 3), (4, 30, 225)}
    assert {tuple(x) for x in spark.read.parquet(str(tmp_path / "changed/elements")).collect()} == {(4, 1, "left")}
    assert [x.node >> 32 for x in spark.read.parquet(str(tmp_path / "changed/nodes")).collect()] == [4]
    log = [x.value for x in spark.read.text(str(tmp_path / "changed/log")).collect()]
    assert "F3CE1 is NOT equal: 12 cells differ, by 3 at most" in log and "F4CE1 is only in the left run" in log and "F1CE1 is equal" in log
    dense = tables.dense_grid(run.elements.pixels.where("frame = 1"), "tb", raster)
    assert dense.count() == 96 and dense.where("tb <> 0").count() == 30


def test_stage_tables_can_be_deleted(spark, tmp_path):
    from pathlib import Path

    from gridtrack.session import stage, unstage

    table = stage(spark.range(3).toDF("x"), "gone")
    folder = Path(table.stage_path.removeprefix("file:"))
    assert folder.exists() and table.count() == 3
    unstage(table)
    assert not folder.exists()


def test_streamed_grids_give_the_same_elements(spark, tmp_path):
    raster = micro_raster(spark, moving_blocks())
    grid = (
        raster.pixels.join(raster.frames, "frame").join(raster.rows, "r").join(raster.cols, "c")
        .select("frame", "ts", "r", "c", "lat", "lon", F.col("tb").cast("double").alias("tb"))
    )
    grid.repartitionByRange(2, "frame").write.parquet(str(tmp_path / "in"))
    query = stream_elements(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"),
                            raster.rows, raster.cols, MICRO, files_per_batch=1)
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/elements")).select("id", "n_px", "bt_avg").collect()
    want = find_elements(raster_from_grid(grid, MICRO, clip=False), MICRO).accepted.select("id", "n_px", "bt_avg").collect()
    assert sorted(got) == sorted(want) and len(got) == 4


def test_run_from_files_with_rain_before_and_after(spark, tmp_path):
    """Blocks written as netCDF, analysed from a configuration, with rain first and attached later."""
    from gridtrack.plans.run import attach_rain_later, load_raster, run

    blocks = np.array(moving_blocks())
    blocks[blocks == 0] = 300
    (tmp_path / "ir").mkdir()
    (tmp_path / "rain").mkdir()
    lat, lon = np.arange(8) + 5.0, np.arange(12) - 5.0
    for hour, block in enumerate(blocks):
        classic_file(tmp_path / f"ir/merg_200908310{hour}_4km.nc", block[None], lat, lon, hour)
    for hour in (0, 3):
        classic_file(tmp_path / f"rain/3B42.20090831.0{hour}.7A.nc", np.full((1, 3, 4), 2), np.array([5.0, 8, 12]),
                     np.array([-5.0, -1, 3, 6]), 0)
    changes = dict(lat_min=5, lat_max=12, lon_min=-5, lon_max=6, grid_dir=str(tmp_path / "ir"), min_mcs_duration=3)
    dry = MICRO.with_options(output_dir=str(tmp_path / "dry"), **changes)
    (tmp_path / "ir/merg_2009083107_4km.nc").write_bytes(b"broken")
    (tmp_path / "wetter").mkdir()
    for hour in (0, 3):
        classic_file(tmp_path / f"wetter/3B42.20090831.0{hour}.7A.nc", np.full((1, 3, 4), 2), np.array([5.0, 8, 12]),
                     np.array([-5.0, -1, 3, 6]), 0, variable="pcp")
    (tmp_path / "wetter/3B42.20090831.06.7A.nc").write_bytes(b"CDF")
    wet = dry.with_options(precip_dir=str(tmp_path / "wetter"), output_dir=str(tmp_path / "wet"), end="2009083107")
    run(spark, wet)
    record = json.loads(spark.read.text(str(tmp_path / "wet/run.json")).first().value)
    assert record["bad_files"] == {"grid": 1, "rain": 1}
    assert {x.kind for x in spark.read.parquet(str(tmp_path / "wet/bad_files")).collect()} == {"grid", "rain"}
    with pytest.raises(ValueError, match="1 of 3 rain files"):
        run(spark, wet.with_options(max_bad_share=0.3))
    run(spark, dry)
    source = gridfiles.read_rain(spark, str(tmp_path / "rain"), variable="ch4").cells
    later = attach_rain_later(spark, dry, load_raster(spark, dry), source)
    assert sorted((x.id, x.n_px, x.precip_total) for x in later.collect()) == [
        (f"F{i}CE1", 30, 60.0) for i in range(1, 5)]
    assert spark.read.parquet(str(tmp_path / "dry/rain_grids")).count() == 120
    kept = stored.read(spark, str(tmp_path / "dry/elements"))
    assert sorted((x.id, x.precip_total) for x in kept.collect()) == [(f"F{i}CE1", 60.0) for i in range(1, 5)]
    assert "precip_total" not in stored.read(spark, str(tmp_path / "dry/elements"), 1).columns
    assert not spark.read.parquet(str(tmp_path / "dry/rain_total")).isEmpty()
    assert {x.behaviour for x in stored.read(spark, str(tmp_path / "dry/nodes")).collect()} == {"N"}
    late = load_raster(spark, dry.with_options(start="2009083102", end="2009083103"))
    assert sorted(x.frame for x in late.frames.collect()) == [1, 2]
    assert {x.frame for x in late.pixels.select("frame").distinct().collect()} == {1, 2}
    with pytest.raises(ValueError, match="period"):
        load_raster(spark, dry.with_options(start="2010083102", end="2010083103"))
