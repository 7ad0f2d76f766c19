"""Run programs: a whole analysis from a configuration, and rain attached afterwards.

``spark-submit gridtrack/plans/run.py config.json`` runs the analysis and
writes all products below the configured output folder.
``spark-submit gridtrack/plans/run.py compare <run> <run> <folder>`` compares the
products of two runs.
"""

from __future__ import annotations

import sys
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from gridtrack.config import TrackConfig  # noqa: E402
from gridtrack.operators.precip import element_rain  # noqa: E402
from gridtrack.operators.raster import Dimensions, Raster, between_times, raster_from_grid  # noqa: E402
from gridtrack.operators.metrics import feature_nodes  # noqa: E402
from gridtrack.plans.pipeline import Analysis, analyse  # noqa: E402
from gridtrack.sinks.tables import located, store_rain, write_accumulations, write_by_day, write_differences, write_products  # noqa: E402
from gridtrack.session import drop_stages, stage  # noqa: E402
from gridtrack.sources.gridfiles import read_grid_files, read_rain  # noqa: E402


def load_raster(spark: SparkSession, config: TrackConfig, source_format: str = "netcdf") -> Raster:
    """Raster of the configured folder: ``parquet`` tables, ``netcdf`` or raw ``merg`` files.

    Frame 1 is the first frame of the configured period.
    """
    return load_grid(spark, config, source_format)[0]


def load_grid(spark: SparkSession, config: TrackConfig, source_format: str = "netcdf") -> tuple[Raster, DataFrame | None]:
    """The raster and the files that could not be read, None for tables.

    Only files of the period are opened, and only cells of the domain, one line
    more on each side, and below the threshold leave the reader.
    """
    if config.grid_dir is None:
        raise ValueError("grid_dir is not configured")
    if source_format == "parquet":
        return raster_from_grid(between_times(spark.read.parquet(config.grid_dir), config), config), None
    if not config.fold_longitudes:
        raise ValueError("axes of grid files are in degrees and always folded")
    read = read_grid_files(
        spark, config.grid_dir, format=source_format, value_max=config.t_bb_max, margin=1,
        lat_min=config.lat_min, lat_max=config.lat_max, lon_min=config.lon_min, lon_max=config.lon_max, **_period(config))
    _too_many_bad("grid", read.bad_files, read.n_files, config)
    frames = between_times(read.frames, config)
    before = frames.agg(F.min("frame") - 1).first()[0]
    if before is None:
        raise ValueError("no grid file falls into the configured period")
    grid, frames = (t.withColumn("frame", F.col("frame") - before) for t in (between_times(read.grid, config), frames))
    return raster_from_grid(grid, config, known=Dimensions(read.rows, read.cols, frames)), read.bad_files


def _period(config: TrackConfig) -> dict[str, str]:
    return {"start": f"{config.start_time:%Y%m%d%H}", "end": f"{config.end_time:%Y%m%d%H}"}


def _too_many_bad(kind: str, bad: DataFrame, n_files: int, config: TrackConfig) -> None:
    n_bad = bad.select("file").distinct().count()
    if n_bad > config.max_bad_share * n_files:
        raise ValueError(f"{n_bad} of {n_files} {kind} files cannot be read, for example: {bad.first()}")


def run(spark: SparkSession, config: TrackConfig, source_format: str = "netcdf") -> Analysis:
    """Detection, tracking and reports.

    Stage seconds, counts and the number of unreadable files go to ``run.json``,
    the files themselves to ``bad_files``.
    """
    raster, bad_grid = load_grid(spark, config, source_format)
    bad = [] if bad_grid is None else [bad_grid.withColumn("kind", F.lit("grid"))]
    rain = None
    if config.precip_dir:
        # a rain file counts for the hours after its time
        read = read_rain(spark, config.precip_dir, **_period(config))
        _too_many_bad("rain", read.bad_files, read.n_files, config)
        rain = read.cells
        bad.append(read.bad_files.withColumn("kind", F.lit("rain")))
    timings: dict[str, float] = {}
    analysis = analyse(raster, config, rain, timings)
    skipped = reduce(DataFrame.unionByName, bad) if bad else None
    write_products(analysis, config, timings, skipped)
    return analysis


def attach_rain_later(spark: SparkSession, config: TrackConfig, raster: Raster, source: DataFrame) -> DataFrame:
    """Attach the second dataset to the tables an earlier run stored, in place; known values stay.

    Rain grids and accumulations are written as the run itself would have; the
    stored elements are returned.
    """
    root = config.output_dir
    pixels = spark.read.parquet(f"{root}/element_grids").select("frame", "ce_no", "r", "c", "tb")
    found = element_rain(pixels, source, raster, tolerance=config.rain_tolerance, fold=config.fold_longitudes)
    rain = stage(found, "element-rain")
    write_by_day(located(rain, raster), f"{root}/rain_grids")
    members = spark.read.parquet(f"{root}/feature_members")
    elements = store_rain(f"{root}/elements", rain, config)
    write_accumulations(feature_nodes(members, elements), rain, raster, config, root)
    return elements


if __name__ == "__main__":
    session = SparkSession.builder.appName("gridtrack").getOrCreate()
    if sys.argv[1] == "compare":
        write_differences(session, *sys.argv[2:5])
    else:
        run(session, TrackConfig.from_json(sys.argv[1]), *sys.argv[2:3])
    drop_stages(session)
