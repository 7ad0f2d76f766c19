"""Grids written as netCDF files: what is in them, and tasks that break off."""

from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtrack.operators.raster import Raster
from gridtrack.sinks import netcdf
from gridtrack.sources import gridfiles
from tests.grids import MICRO, micro_raster

TS = datetime(2009, 8, 31, 5, 30)


def cells(spark, rows):
    return spark.createDataFrame(rows, "file string, ts timestamp_ntz, r int, c int, value double")


def names(folder):
    return sorted(str(f.relative_to(folder)) for f in Path(folder).rglob("*") if f.is_file() and not f.name.endswith(".crc"))


def raster(spark):
    return micro_raster(spark, [[[220] * 5 for _ in range(3)]], lat0=7.0, lon0=-2.0)


def write(spark, rows, path, mode="overwrite"):
    netcdf.write_grids(rows, raster(spark), str(path), "rainfall", "mm", "rain", mode)


def test_written_grids_are_read_back(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"grid{i}.nc", TS.replace(day=1 + i), int(r), int(c), float(rng.normal())) for i in range(12) for r, c in rng.integers(0, (3, 5), (9, 2))]
    rows = list({row[:4]: row for row in rows}.values())
    write(spark, cells(spark, rows).repartition(5), tmp_path / "out")
    assert names(tmp_path / "out") == sorted({row[0] for row in rows})
    read = gridfiles.read_grid_files(spark, str(tmp_path / "out"), variable="rainfall")
    assert read.bad_files.isEmpty() and read.frames.count() == 12
    got = {(x.file.rsplit("/", 1)[1], x.ts, x.r, x.c): x.tb for x in read.grid.where("tb <> 0").collect()}
    assert got == {row[:4]: row[4] for row in rows}
    assert read.grid.count() == 12 * 15
    assert [x.lat for x in read.rows.orderBy("r").collect()] == [7.0, 8.0, 9.0]
    assert [x.lon for x in read.cols.orderBy("c").collect()] == [-2.0, -1.0, 0.0, 1.0, 2.0]
    # written anew, files that are not among the new ones go; appended, they stay
    write(spark, cells(spark, rows[:1]), tmp_path / "out", "append")
    assert len(names(tmp_path / "out")) == 12
    write(spark, cells(spark, rows[:1]), tmp_path / "out")
    assert names(tmp_path / "out") == ["grid0.nc"]


def test_a_task_that_breaks_off_leaves_no_file(spark, tmp_path):
    write(spark, cells(spark, [("kept.nc", TS, 0, 0, 1.0)]), tmp_path / "out")
    before = (tmp_path / "out/kept.nc").read_bytes()
    rows = cells(spark, [(f"grid{i}.nc", TS, i % 3, i % 5, 1.0) for i in range(40)] + [("kept.nc", TS, 1, 1, 9.0)])
    broken = rows.withColumn("value", F.when(F.col("file") == "grid37.nc", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        write(spark, broken, tmp_path / "out")
    assert names(tmp_path / "out") == ["kept.nc"] and (tmp_path / "out/kept.nc").read_bytes() == before
    assert not list((tmp_path / "out").glob(".pending*"))


def test_a_writer_deletes_its_own_files_when_rows_fail(tmp_path):
    """The writer by itself, in this process: one file is done when the rows break off."""
    import pyarrow as pa

    axis = netcdf.packed([0.0, 1.0])
    writer = netcdf.GridWriter({"path": str(tmp_path), "rows": axis, "lat": axis, "cols": axis, "lon": axis, "variable": "v", "units": "mm", "description": "d"}, False)

    def batch(file):
        return pa.RecordBatch.from_pydict({"file": [file], "ts": [TS], "r": pa.array([1], pa.int32()), "c": pa.array([0], pa.int32()), "value": [2.5]})

    def rows():
        yield batch("a.nc")
        yield batch("b.nc")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        writer.write(rows())
    assert names(tmp_path) == []
    message = writer.write(iter([batch("a.nc"), batch("b.nc")]))
    assert [f for _, f in message.files] == ["a.nc", "b.nc"] and len(names(tmp_path)) == 2
    writer.commit([message, None])
    assert names(tmp_path) == ["a.nc", "b.nc"]


def test_no_cells_no_files(spark, tmp_path):
    write(spark, cells(spark, []), tmp_path / "out")
    assert names(tmp_path / "out") == []


#: even, uneven, with a gap in its lines, and folded at 180 degrees
AXES = [-5 + 0.25 * np.arange(2000), np.sort(np.random.default_rng(1).uniform(0, 90, 2000)),
        np.delete(-5 + 0.25 * np.arange(2002), [7, 900]), np.concatenate([0.25 * np.arange(721), 0.25 * np.arange(-719, 560)])]


@pytest.mark.parametrize("lon", AXES, ids=["even", "uneven", "gap", "folded"])
def test_gathered_grids_are_the_plain_ones(spark, tmp_path, lon):
    rng = np.random.default_rng(6)
    rows = [(f"grid{i}.nc", TS.replace(day=1 + i), int(r), int(c), v) for i in range(3)
            for (r, c), v in zip(rng.integers(0, (3, lon.size), (40, 2)), [float("nan"), 0.0, *rng.normal(0, 9, 38).tolist()])]
    rows += [("full.nc", TS.replace(day=20), r, c, 1.0 + r + c) for r in range(3) for c in range(lon.size)]
    rows = spark.createDataFrame(list({row[:4]: row for row in rows}.values()), "file string, ts timestamp_ntz, r int, c int, value double")
    axes = [spark.createDataFrame([(i, float(x)) for i, x in enumerate(a)], f"{line} int, {degrees} double")
            for a, line, degrees in (([7.0, 8.5, 9.0], "r", "lat"), (lon, "c", "lon"))]
    domain = Raster(None, *axes, None)
    for kind in (False, True):
        netcdf.write_grids(rows, domain, str(tmp_path / str(kind)), "rainfall", "mm", "rain", gathered=kind)
    sizes = {x.name: x.stat().st_size for x in (tmp_path / "True").glob("*.nc")}
    assert sorted(sizes) == names(tmp_path / "False") and sizes["full.nc"] == (tmp_path / "False/full.nc").stat().st_size
    # of an uneven axis all lines are in the file; a plain one has 48,000 bytes of cells besides
    assert max(x for name, x in sizes.items() if name != "full.nc") < (18_000 if lon is AXES[1] else 2048)

    def read(kind, where):
        with gridfiles.pushing(spark):
            found = gridfiles.open_files(spark, str(tmp_path / str(kind)), variable="rainfall").where(where)
            return sorted((tuple(row) for row in found.withColumn("file", F.element_at(F.split("file", "/"), -1)).collect()), key=repr)

    for where in ("true", "kind = 'cell' AND value > 0", "kind = 'cell' AND value < 0 AND lat > 8 AND lon BETWEEN 20 AND 60", "kind = 'cell' AND value >= 0 AND lon < 1"):
        found = read(True, where)
        assert found and found == read(False, where)


def test_many_small_files_share_a_partition(tmp_path):
    axis = np.array([1.0, 2.0])
    options = {"variable": "v", "units": "mm", "description": "d"}
    for i in range(700):
        (tmp_path / f"{i}.nc").write_bytes(netcdf.classic_bytes(np.full((2, 2), float(i + 1)), axis, axis, TS, options))
    reader = gridfiles.NetcdfReader({"path": str(tmp_path), "variable": "v"})
    parts = reader.partitions()
    assert 64 <= len(parts) <= 80
    read = [list(reader.read(part)) for part in parts]
    assert all(len(batches) == 1 for batches in read)
    found = [row for batches in read for row in batches[0].to_pylist() if row["kind"] == "cell"]
    assert sorted(row["value"] for row in found) == sorted(float(i + 1) for i in range(700) for _ in range(4))
    assert all(row["file"].endswith(f"/{int(row['value']) - 1}.nc") for row in found)
    few = gridfiles.NetcdfReader({"path": str(tmp_path), "variable": "v", "split_bytes": "100"}).partitions()
    assert len(few) > 700  # files of more bytes than that are several


def test_products_of_a_run(spark, tmp_path):
    from gridtrack.plans import pipeline
    from gridtrack.sinks import tables
    from tests.test_sources_and_sinks import moving_blocks

    config = MICRO.with_options(output_dir=str(tmp_path), outer_area=300, inner_area=100, minimum_duration=3)
    source = spark.createDataFrame(
        [(f"2009-08-31 0{t}:00:00", float(a), float(b), 2.0) for t in (0, 3) for a in (0, 4, 8) for b in (0, 6, 12)],
        "t string, lat double, lon double, value double").selectExpr("cast(t as timestamp_ntz) ts", "lat", "lon", "value")
    run = pipeline.analyse(micro_raster(spark, moving_blocks()), config, source)
    tables.write_netcdf(run, config)
    assert names(tmp_path / "MERGnetcdfCEs") == [f"cloudElements2009-08-31_0{i - 1}:00:00F{i}CE1.nc" for i in range(1, 5)]
    rain = names(tmp_path / "TRMMnetcdfCEs")
    assert rain[:4] == [f"TRMM2009-08-31_0{i - 1}:00:00F{i}CE1.nc" for i in range(1, 5)]
    assert [x for x in rain[4:] if x.startswith("accu2009")] == ["accu2009-08-31_00:00:00-2009-08-31_21:00:00.nc"] and len(rain) > 5
    cells = gridfiles.open_files(spark, str(tmp_path / "TRMMnetcdfCEs"), variable="precipitation_Accumulation").where("kind = 'cell' AND value > 0")
    total = {x.f: x.s for x in cells.groupBy(F.element_at(F.split("file", "/"), -1).alias("f")).agg(F.sum("value").alias("s")).collect()}
    assert total[rain[0]] == 60.0 and total["accu2009-08-31_00:00:00-2009-08-31_21:00:00.nc"] == 240.0
