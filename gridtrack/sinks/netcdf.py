"""Grids as classic netCDF files, written by Spark tasks from sparse cells.

Data source ``gridnetcdf`` takes rows ``(file, ts, r, c, value)`` with all rows of a file in
one partition, one after the other.  A task fills one grid at a time, 0 where there
is no cell, and writes it below a folder of its job that readers do not look
at.  When all tasks are done the files are moved to their names; when the job
fails they are deleted, so a task that breaks off leaves no file behind.

A file has the grid of the whole domain, as a plain array or, with the option ``gathered``,
as CF stores sparse grids: the cells that rows gave and their places, and tie points of the
axes.  ``gridfiles`` reads the same rows from either.  A gathered file grows with its cells
and not with the domain; only of an axis without even stretches all lines are in every file.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gridtrack.operators.raster import Raster
from gridtrack.session import ship_package
from gridtrack.sources.classic_netcdf import ATTRIBUTES, DIMENSIONS, VARIABLES, tie_points
from gridtrack.sources.gridfiles import filesystem

SCHEMA = "file string, ts timestamp_ntz, r int, c int, value double"
# fixed values: codes of the classic format
CHAR, NUMBERS = 2, {">i4": 4, ">f8": 6}


class GridNetcdf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridnetcdf"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return GridWriter(dict(self.options), overwrite)


@dataclass
class Written(WriterCommitMessage):
    """``(pending name, final name)`` of the files of a task."""

    files: list[tuple[str, str]]


class GridWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.options, self.overwrite = options, overwrite
        self.folder = f".pending-{uuid.uuid4().hex}"
        self.rows, self.lat, self.cols, self.lon = (unpacked(options[x]) for x in ("rows", "lat", "cols", "lon"))
        self.gathered = options.get("gathered", "false") == "true"
        self.ties = [few_ties(x) for x in (self.lat, self.lon)] if self.gathered else None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = filesystem(self.options["path"])
        system.create_dir(f"{root}/{self.folder}", recursive=True)
        done: list[tuple[str, str]] = []
        try:
            for file, ts, places, values in self._grids(iterator):
                pending = f"{uuid.uuid4().hex}.nc"
                done.append((pending, file))
                with system.open_output_stream(f"{root}/{self.folder}/{pending}") as out:
                    out.write(self._content(ts, places, values))
        except BaseException:
            self._delete(done)
            raise
        return Written(done)

    def _grids(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, datetime, np.ndarray, np.ndarray]]:
        """Name, time, places in the flat grid and values of the cells, file by file."""
        shape, file, ts, places, values = (self.rows.size, self.cols.size), None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            names, times = batch.column("file").to_pylist(), batch.column("ts")
            r = np.searchsorted(self.rows, batch.column("r").to_numpy())
            c = np.searchsorted(self.cols, batch.column("c").to_numpy())
            place, value = np.ravel_multi_index((r, c), shape), batch.column("value").to_numpy(zero_copy_only=False)
            starts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for low, high in zip(starts, starts[1:]):
                if names[low] != file:
                    if file is not None:
                        yield file, ts, np.concatenate(places), np.concatenate(values)
                    file, ts, places, values = names[low], times[low].as_py(), [], []
                places.append(place[low:high])
                values.append(value[low:high])
        if file is not None:
            yield file, ts, np.concatenate(places), np.concatenate(values)

    def _content(self, ts: datetime, places: np.ndarray, values: np.ndarray) -> bytes:
        if self.gathered:
            order = np.argsort(places, kind="stable")
            places, values = places[order], values[order]
            last = np.append(places[1:] != places[:-1], True)  # of rows for the same cell the last one counts
            places, values = places[last], values[last]
            if 3 * places.size < 2 * self.rows.size * self.cols.size:  # 12 bytes a cell, or 8
                return gathered_bytes(places, values, self.lat, self.lon, self.ties, ts, self.options)
        grid = np.zeros(self.rows.size * self.cols.size)
        grid[places] = values
        return classic_bytes(grid.reshape(self.rows.size, self.cols.size), self.lat, self.lon, ts, self.options)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = filesystem(self.options["path"])
        system.create_dir(root, recursive=True)
        files = {final: pending for message in messages if message is not None for pending, final in message.files}
        if self.overwrite:
            from pyarrow import fs

            for old in system.get_file_info(fs.FileSelector(root)):
                if old.type == fs.FileType.File and old.base_name.endswith(".nc") and old.base_name not in files:
                    system.delete_file(old.path)
        for final, pending in files.items():
            system.move(f"{root}/{self.folder}/{pending}", f"{root}/{final}")
        self._delete_folder()

    def abort(self, messages: list[Written | None]) -> None:
        self._delete_folder()

    def _delete(self, files: list[tuple[str, str]]) -> None:
        from pyarrow import fs

        system, root = filesystem(self.options["path"])
        for pending, _ in files:
            path = f"{root}/{self.folder}/{pending}"
            if system.get_file_info(path).type == fs.FileType.File:
                system.delete_file(path)

    def _delete_folder(self) -> None:
        from pyarrow import fs

        system, root = filesystem(self.options["path"])
        if system.get_file_info(f"{root}/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.folder}")


# --- the format ----------------------------------------------------------------------------------

def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 4)


def _text(value: str) -> bytes:
    data = value.encode()
    return struct.pack(">i", len(data)) + _padded(data)


def _attributes(items: dict[str, str]) -> bytes:
    if not items:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", ATTRIBUTES, len(items))
    for name, value in items.items():
        data = value.encode()
        out += _text(name) + struct.pack(">ii", CHAR, len(data)) + _padded(data)
    return out


def _file(dims: dict[str, int], variables: list[tuple[str, list[str], dict[str, str], np.ndarray]], options: dict,
          conventions: str) -> bytes:
    """One record of the dimension ``time`` and what does not depend on it, with 64-bit offsets."""
    about = {"description": options["description"], "calendar": "standard", "conventions": conventions}
    names = list(dims)

    def header(begins: dict[str, int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", 1) + struct.pack(">ii", DIMENSIONS, len(dims))
        for name, size in dims.items():
            out += _text(name) + struct.pack(">i", size)
        out += _attributes(about) + struct.pack(">ii", VARIABLES, len(variables))
        for name, own, attributes, data in variables:
            out += _text(name) + struct.pack(f">i{len(own)}i", len(own), *map(names.index, own)) + _attributes(attributes)
            out += struct.pack(">iIq", NUMBERS[data.dtype.str], min(data.nbytes, 2**32 - 1), begins.get(name, 0))
        return out

    stored = sorted(variables, key=lambda x: "time" in x[1])  # records come last
    begins, end = {}, len(header({}))
    for name, _, _, data in stored:
        begins[name], end = end, end + data.nbytes
    return header(begins) + b"".join(data.tobytes() for *_, data in stored)


# fixed values: names and attributes of the published products
LATITUDE = {"units": "degrees_north", "long_name": "Latitude"}
LONGITUDE = {"units": "degrees_east", "long_name": "Longitude"}


def _time(ts: datetime) -> tuple[str, list[str], dict[str, str], np.ndarray]:
    hour = ts.replace(minute=0, second=0, microsecond=0)
    return "time", ["time"], {"units": f"hours since {hour:%Y-%m-%d %H}"}, np.array([(ts - hour).total_seconds() / 3600], ">f8")


def classic_bytes(grid: np.ndarray, lat: np.ndarray, lon: np.ndarray, ts: datetime, options: dict) -> bytes:
    """One grid at one time as a classic file."""
    return _file({"time": 0, "lat": lat.size, "lon": lon.size}, [
        _time(ts), ("latitude", ["lat"], LATITUDE, lat.astype(">f8")), ("longitude", ["lon"], LONGITUDE, lon.astype(">f8")),
        (options["variable"], ["time", "lat", "lon"], {"units": options["units"]}, grid.astype(">f8")),
    ], options, "COARDS")


def few_ties(axis: np.ndarray) -> np.ndarray | None:
    """Tie points of an axis, None if its lines take no more room."""
    ties = tie_points(axis)
    return ties if 12 * ties.size + 256 < 8 * axis.size else None  # with what they add to the header


def gathered_bytes(places: np.ndarray, values: np.ndarray, lat: np.ndarray, lon: np.ndarray, ties: list[np.ndarray | None], ts: datetime,
                   options: dict) -> bytes:
    """The same grid by its cells: CF compression by gathering, axes by coordinate subsampling, which ``tie_points`` keeps exact."""
    dims = {"time": 0, "lat": lat.size, "lon": lon.size, "cell": places.size}
    variables, rules = [_time(ts)], []
    for dim, name, about, axis, index in (("lat", "latitude", LATITUDE, lat, ties[0]), ("lon", "longitude", LONGITUDE, lon, ties[1])):
        if index is None:
            variables.append((name, [dim], about, axis.astype(">f8")))
            continue
        dims[f"{dim}_tie"] = index.size
        rules.append(f"{name}: {dim}_rule")
        variables += [
            (name, [f"{dim}_tie"], about, axis[index].astype(">f8")), (f"{dim}_line", [f"{dim}_tie"], {}, index.astype(">i4")),
            (f"{dim}_rule", [], {"interpolation_name": "linear", "tie_point_mapping": f"{dim}: {dim}_line {dim}_tie"}, np.zeros((), ">i4"))]
    number = ">i4" if lat.size * lon.size <= 2**31 else ">f8"  # the format has no longer integers
    variables.append(("cell", ["cell"], {"compress": "lat lon"}, places.astype(number)))
    about = {"units": options["units"]} | ({"coordinate_interpolation": " ".join(rules)} if rules else {})
    return _file(dims, [*variables, (options["variable"], ["time", "cell"], about, values.astype(">f8"))], options, "CF-1.9")


# --- the products --------------------------------------------------------------------------------

def packed(values) -> str:
    return base64.b64encode(np.asarray(values, dtype=np.float64).tobytes()).decode()


def unpacked(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=np.float64)


def write_grids(cells: DataFrame, raster: Raster, path: str, variable: str, units: str, description: str, mode: str = "overwrite",
                gathered: bool = False) -> None:
    """A netCDF file for every ``file`` of ``cells(file, ts, r, c, value)``, over the whole domain of the raster.

    ``gathered`` stores the cells alone where that takes less room, see above.
    """
    spark = cells.sparkSession
    ship_package(spark)
    spark.dataSource.register(GridNetcdf)
    axes = {}
    for table, line, degrees in ((raster.rows, "r", "lat"), (raster.cols, "c", "lon")):
        found = table.select(line, degrees).orderBy(line).toArrow()  # a row per line of the grid
        axes |= {{"r": "rows", "c": "cols"}[line]: packed(found.column(line)), degrees: packed(found.column(degrees))}
    rows = cells.select("file", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"),
                        F.col("value").cast("double").alias("value"))
    rows.repartition("file").sortWithinPartitions("file").write.format("gridnetcdf").mode(mode).options(
        path=path, variable=variable, units=units, description=description, gathered=gathered, **axes).save()


def element_grids(cells: DataFrame, value: str, raster: Raster, prefix: str) -> DataFrame:
    """``(file, ts, r, c, value)``: a file for every element."""
    from gridtrack.functions.dates import element_file_name
    from gridtrack.operators.elements import element_id

    named = cells.join(raster.frames, "frame")
    return named.select(element_file_name("ts", element_id("frame", "ce_no"), prefix).alias("file"), "ts", "r", "c", F.col(value).alias("value"))


def summed_grid(cells: DataFrame, name: Column, ts: Column) -> DataFrame:
    """``(file, ts, r, c, value)`` of accumulated rain; ``name`` and ``ts`` say which file a cell belongs to and its time."""
    return cells.select(name.alias("file"), ts.alias("ts"), "r", "c", F.col("rain").alias("value"))
