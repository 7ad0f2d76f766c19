"""Data source ``gridfiles``: gridded files as rows, with filters and splits below a file.

A row is a cell, or by its ``kind`` one of three others: every slice yields one
row without a cell, so a slice with no cell left still counts as a frame; every
file yields one row per axis line (``r`` or ``c`` is NULL); a file or slice that
cannot be read yields one row with ``error`` set, so callers can skip and count it.
Undefined cells are no rows.

Filters of a plain ``where`` are pushed into the source where the session has
``spark.sql.python.filterPushdown.enabled``: ``kind``, ``file``, ``t``, ``ts``, ``lat``, ``lon``
and ``value`` against constants.  Files whose name says that they begin after the
latest ``ts`` are not opened; slices and rows that a filter rules out are not read,
and without cells wanted only headers are.  Of a netCDF grid stored by some of its cells, the others
are read as 0, or not made at all where a filter rules 0 out.

A file of more than ``split_bytes`` is several partitions, of whole slices or of
bands of rows; many small files share a partition.  The driver only lists names and sizes; a task opens the header and
takes its part of the bands.  Before a slice is read, the file's size is held against
the end of the slice, so a file that breaks off gives an error row in place of
half a frame whatever task reads it.

Options: ``path``; ``format`` (``netcdf`` or ``merg``); ``variable``, ``latitude``,
``longitude``, ``time``; ``split_bytes``; ``named_from`` and ``named_until`` as ``yyyymmddHH``:
files whose name has an earlier or later time are left out unopened.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from gridtrack.functions.dates import model_time, time_step_class
from gridtrack.functions.geo import normalize_longitude
from gridtrack.operators.numbering import number_rows
from gridtrack.sources.classic_netcdf import ClassicFile
from gridtrack.session import ship_package, stage
from gridtrack.sources.files import file_time

SCHEMA = (
    "kind string, file string, t int, ts timestamp_ntz, time_units string, time_offset double, "
    "r int, c int, lat double, lon double, value double, error string"
)
ARROW = pa.schema([
    ("kind", pa.string()), ("file", pa.string()), ("t", pa.int32()), ("ts", pa.timestamp("us")),
    ("time_units", pa.string()), ("time_offset", pa.float64()), ("r", pa.int32()), ("c", pa.int32()),
    ("lat", pa.float64()), ("lon", pa.float64()), ("value", pa.float64()), ("error", pa.string()),
])
CELL, SLICE, AXIS, ERROR = "cell", "slice", "axis", "error"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

# fixed values: descriptor of the raw global infrared files
RAW_COLUMNS, RAW_ROWS = 9896, 3298
RAW_LON0, RAW_LON_STEP = 0.0182, 0.036378335
RAW_LAT0, RAW_LAT_STEP = -59.982, 0.036383683
RAW_ADD, RAW_UNDEFINED, RAW_MINUTES = 75, 330, 30
# fixed values: a day in a file name, with hour and minute where given, or a month
NAME_TIME = re.compile(r"(?:^|[^0-9])(\d{8})[_.,-]?(\d{2})?[_.,-]?(\d{2})?(?:[^0-9]|$)")
NAME_MONTH = re.compile(r"(?:^|[^0-9])(\d{6})(?:[^0-9]|$)")
#: rows of a slice that are read at once
BAND = 256
SPLIT_BYTES = 64 << 20
#: up to so many partitions a file is one by itself; in a shared one, opening it counts as so many bytes more
OWN_SPLITS, OPEN_BYTES = 64, 64 << 10
#: smaller batches are put together
BATCH_ROWS = 8192


@dataclass
class Split(InputPartition):
    """Part ``number`` of ``of`` equal parts of the bands of ``(file, size)``; several files are whole."""

    files: list[tuple[str, int]]
    number: int = 0
    of: int = 1


@dataclass
class Range:
    """Values that the pushed filters leave."""

    low: object = None
    high: object = None
    above: bool = False  # strictly
    below: bool = False
    among: set | None = None

    def narrow(self, kind: type, value) -> None:
        if kind in (GreaterThan, GreaterThanOrEqual) and (self.low is None or value >= self.low):
            self.low, self.above = value, kind is GreaterThan or (self.above and value == self.low)
        elif kind in (LessThan, LessThanOrEqual) and (self.high is None or value <= self.high):
            self.high, self.below = value, kind is LessThan or (self.below and value == self.high)
        elif kind in (EqualTo, In):
            values = {value} if kind is EqualTo else set(value)
            self.among = values if self.among is None else self.among & values

    def holds(self, x) -> bool:
        return bool(self.hold(np.array([x], dtype=object))[0])

    def hold(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(x.shape, dtype=bool)
        if self.low is not None:
            out &= x > self.low if self.above else x >= self.low
        if self.high is not None:
            out &= x < self.high if self.below else x <= self.high
        if self.among is not None:
            out &= np.isin(x, list(self.among)) if x.dtype != object else np.array([v in self.among for v in x.flat], dtype=bool).reshape(x.shape)
        return out


class GridFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = self.options.get("format", "netcdf")
        readers = {"netcdf": (NetcdfReader, PushedNetcdfReader), "merg": (RawReader, PushedRawReader)}
        if kind not in readers:
            raise ValueError(f"format must be one of {sorted(readers)}")
        # Spark refuses readers that take filters where the session does not push any
        return readers[kind][self.options.get("pushdown") == "true"](dict(self.options))


class _SliceReader(DataSourceReader):
    filtered = ("kind", "file", "t", "ts", "lat", "lon", "value")

    def __init__(self, options: dict) -> None:
        self.options = options
        self.ranges = {name: Range() for name in self.filtered}

    def partitions(self) -> list[Split]:
        files = _list(self.options["path"])
        if not files:
            raise ValueError(f"no grid files in {self.options['path']}")
        share = int(self.options.get("split_bytes", SPLIT_BYTES))
        parts = [(file, size, max(1, -(-size // share))) for file, size in files if self.wanted(file)]
        small = [(file, size) for file, size, n in parts if n == 1]
        return [Split([(file, size)], i, n) for file, size, n in parts if n > 1 for i in range(n)] + _shared(small, share)

    def wanted(self, file: str) -> bool:
        """False when the file, or the time in its name, is ruled out; names without a time are kept."""
        begins = name_time(file)
        low, high = (_whole_hour(self.options[x]) if x in self.options else None for x in ("named_from", "named_until"))
        latest = self.ranges["ts"].high
        outside = begins is not None and (
            (low is not None and begins < low) or (high is not None and begins > high) or (latest is not None and begins > latest))
        return self.ranges["file"].holds(file) and not outside

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        yield from _merged(batch for file, size in partition.files for batch in self.part(file, size, partition.number, partition.of))

    def part(self, file: str, size: int, number: int, of: int) -> Iterator[pa.RecordBatch]:
        wants = self.ranges["kind"].holds
        try:
            grid = self.open(file)
            whole = [grid.end(t) <= size for t in range(grid.count)]
            times = [grid.time(t) if whole[t] else None for t in range(grid.count)]
        except _UNREADABLE as problem:
            if wants(ERROR):
                yield _error_row(file, f"{type(problem).__name__}: {problem}")
            return
        # what goes wrong from here on fails the task: half a frame must not pass as one
        with grid:
            if wants(AXIS) and number == 0:
                yield _axis_rows(file, grid.lat, grid.lon)
            bands = max(1, -(-grid.lat.size // grid.band))
            units = grid.count * bands
            for unit in range(number * units // of, (number + 1) * units // of):
                t, band = divmod(unit, bands)
                if not whole[t]:
                    if band == 0 and wants(ERROR):
                        yield _error_row(file, f"slice {t} breaks off at {size} of {grid.end(t)} bytes")
                    continue
                time_units, offset = times[t]
                ts = model_time(time_units, offset) if time_units else _by_name(file, offset)
                if not self.ranges["t"].holds(t) or (ts is not None and not self.ranges["ts"].holds(ts)):
                    continue
                if band == 0 and wants(SLICE):
                    yield _rows(kind=[SLICE], file=[file], t=[t], ts=[ts], time_units=[time_units], time_offset=[offset])
                if wants(CELL):
                    yield from self.cells(grid, file, t, ts, time_units, offset, band * grid.band)

    def cells(self, grid, file: str, t: int, ts, units: str, offset: float, first: int) -> Iterator[pa.RecordBatch]:
        """The cells of a band of rows that the filters leave; a band outside them is not read."""
        if grid.gathered is not None and not self.ranges["value"].holds(0.0):
            r, c, lat, lon, values = grid.stored(t, first, first + grid.band)
            lon = self._folded(lon)
            keep = self.ranges["lat"].hold(lat) & self.ranges["lon"].hold(lon) & self.ranges["value"].hold(values) & ~np.isnan(values)
            r, c, lat, lon, values = (x[keep] for x in (r, c, lat, lon, values))
        else:
            lat, lon = grid.lat[first: first + grid.band], self._folded(grid.lon)
            rows, cols = self.ranges["lat"].hold(lat), self.ranges["lon"].hold(lon)
            if not rows.any() or not cols.any():
                return
            above, upto = np.flatnonzero(rows)[[0, -1]] + (0, 1)
            band = grid.rows(t, first + above, first + upto)
            keep = rows[above:upto, None] & cols[None, :] & self.ranges["value"].hold(band) & ~np.isnan(band)
            r, c = np.nonzero(keep)
            lat, lon, values, r = lat[r + above], lon[c], band[r, c], r + first + above
        size = r.size
        if size:
            yield pa.RecordBatch.from_arrays([
                pa.repeat(CELL, size), pa.repeat(file, size), pa.array(np.full(size, t, np.int32)), pa.repeat(pa.scalar(ts, pa.timestamp("us")), size),
                pa.repeat(units, size), pa.array(np.full(size, float(offset))), pa.array(r.astype(np.int32)),
                pa.array(c.astype(np.int32)), pa.array(lat), pa.array(lon), pa.array(values), pa.nulls(size, pa.string()),
            ], schema=ARROW)

    def _folded(self, lon: np.ndarray) -> np.ndarray:
        fold = self.options.get("fold", "true") == "true"
        return np.where((lon > 180) & fold, lon - 360, lon)


class NetcdfReader(_SliceReader):
    """Classic netCDF directly; netCDF-4 where that library is installed."""

    def open(self, file: str):
        return _open_netcdf(file, *[self.options.get(x, default) for x, default in (
            ("variable", "ch4"), ("time", "time"), ("latitude", "latitude"), ("longitude", "longitude"))])


class RawReader(_SliceReader):
    """Raw global files: one byte per cell, two half-hour slices, northern row first."""

    def open(self, file: str):
        return _Raw(file)


class _Pushed:
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrow what is read; Spark still applies every filter itself."""
        for one in filters:
            name = getattr(one, "attribute", ("",))[0]
            if name in self.ranges and type(one) in (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                self.ranges[name].narrow(type(one), one.value)
            yield one


class PushedNetcdfReader(_Pushed, NetcdfReader):
    pass


class PushedRawReader(_Pushed, RawReader):
    pass


class _Raw:
    gathered = None

    def __init__(self, file: str) -> None:
        system, inner = filesystem(file)
        size = system.get_file_info(inner).size
        self.count, rest = divmod(size, RAW_ROWS * RAW_COLUMNS)
        if rest or not self.count:
            raise ValueError(f"{size} bytes are no whole number of slices")
        self.lat = RAW_LAT0 + RAW_LAT_STEP * np.arange(RAW_ROWS)
        self.lon = RAW_LON0 + RAW_LON_STEP * np.arange(RAW_COLUMNS)
        self.band = BAND
        self.handle = _open(file)

    def time(self, t: int) -> tuple[str, float]:
        return "", float(t * RAW_MINUTES)

    def end(self, t: int) -> int:
        return (t + 1) * RAW_ROWS * RAW_COLUMNS

    def rows(self, t: int, first: int, last: int) -> np.ndarray:
        self.handle.seek((t * RAW_ROWS + RAW_ROWS - last) * RAW_COLUMNS)
        raw = np.frombuffer(self.handle.read((last - first) * RAW_COLUMNS), np.uint8)
        values = raw.reshape(last - first, RAW_COLUMNS)[::-1].astype(float) + RAW_ADD
        values[values == RAW_UNDEFINED] = np.nan
        return values

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.handle.close()


class _Classic:
    def __init__(self, file: str, variable: str, time: str, latitude: str, longitude: str) -> None:
        self.handle = _open(file)
        self.grid = ClassicFile(self.handle)
        self.variable, self.times = variable, time
        self.count = self.grid.variables[variable].shape[0]
        self.axes = [self.grid.axis(x, variable) for x in (latitude, longitude)]
        self.gathered = self.grid.gathered(variable)
        self.units = self.grid.variables[time].attributes["units"]
        self.band = BAND

    @cached_property
    def lat(self) -> np.ndarray:
        return self.axes[0].whole()

    @cached_property
    def lon(self) -> np.ndarray:
        return self.axes[1].whole()

    def time(self, t: int) -> tuple[str, float]:
        return self.units, float(self.grid.record(self.times, t))

    def end(self, t: int) -> int:
        return max(self.grid.end(self.variable, t), self.grid.end(self.times, t))

    def rows(self, t: int, first: int, last: int) -> np.ndarray:
        if self.gathered is None:
            return self.grid.rows(self.variable, t, first, last).astype(float)
        values = np.zeros((last - first, self.axes[1].size))
        r, c, *_, stored = self.stored(t, first, last)
        values[r - first, c] = stored
        return values

    def stored(self, t: int, first: int, last: int) -> tuple[np.ndarray, ...]:
        """``(r, c, lat, lon, value)`` of the stored cells in rows ``first`` to ``last`` (exclusive)."""
        places, shape = self.gathered
        r, c = np.unravel_index(places, shape)
        inside = (r >= first) & (r < last)
        r, c = r[inside], c[inside]
        return r, c, self.axes[0].at(r), self.axes[1].at(c), self.grid.record(self.variable, t).astype(float)[inside]

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.handle.close()


class _Netcdf4:
    """Chunks are compressed, so a slice is one band and only reading it shows whether it is whole."""

    gathered = None

    def __init__(self, file: str, variable: str, time: str, latitude: str, longitude: str) -> None:
        from netCDF4 import Dataset

        self.data = Dataset(filesystem(file)[1], "r")
        self.values, self.times = self.data.variables[variable], self.data.variables[time]
        self.count = self.values.shape[0]
        self.lat, self.lon = (np.ma.filled(self.data.variables[x][:], np.nan).astype(float) for x in (latitude, longitude))
        self.band = max(1, self.lat.size)

    def time(self, t: int) -> tuple[str, float]:
        return self.times.units, float(self.times[t])

    def end(self, t: int) -> int:
        return 0

    def rows(self, t: int, first: int, last: int) -> np.ndarray:
        return np.ma.filled(self.values[t, first:last], np.nan).astype(float)

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.data.close()


#: what a file that is no grid file, or is damaged, makes readers raise; other errors fail the task
_UNREADABLE = (ValueError, KeyError, IndexError, OSError, struct.error, UnicodeDecodeError, TypeError)


def _open_netcdf(file: str, *names: str):
    with _open(file) as handle:
        classic = handle.read(3) == b"CDF"
    if classic:
        return _Classic(file, *names)
    try:
        return _Netcdf4(file, *names)
    except ImportError as problem:
        raise ValueError("not a classic netCDF file, and netCDF4 is not installed") from problem


def name_time(file: str) -> datetime | None:
    """Time in a file's name, as ``sources.files.file_time`` has it."""
    name = file.rsplit("/", 1)[-1]
    day, month = NAME_TIME.search(name), NAME_MONTH.search(name)
    tries = [(day[1] + ((day[2] or "") + (day[3] or "")).ljust(4, "0"), "%Y%m%d%H%M")] if day else []
    for text, form in [*tries, *([(month[1], "%Y%m")] if month else [])]:
        try:
            return datetime.strptime(text, form)
        except ValueError:
            continue
    return None


def _by_name(file: str, minutes: float) -> datetime | None:
    begins = name_time(file)
    return None if begins is None else begins + timedelta(minutes=int(minutes))


def _whole_hour(text: str) -> datetime:
    return datetime.strptime(text[:10], "%Y%m%d%H")


def filesystem(path: str):
    """File system of a path or URI, and the path on it."""
    from pyarrow import fs

    if path.startswith("file:/") and "://" not in path:
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _open(path: str):
    system, inner = filesystem(path)
    return system.open_input_file(inner)


def _list(path: str) -> list[tuple[str, int]]:
    """Files of a folder, or the file itself, and their sizes."""
    from pyarrow import fs

    system, inner = filesystem(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File)


def _shared(files: list[tuple[str, int]], share: int) -> list[Split]:
    """Whole files, up to ``share`` bytes in a partition; ``OWN_SPLITS`` files or fewer have one each."""
    room = min(share, sum(size + OPEN_BYTES for _, size in files) // OWN_SPLITS) if len(files) > OWN_SPLITS else 0
    splits, left = [], 0
    for file, size in files:
        left -= size + OPEN_BYTES
        if left < 0:
            splits.append(Split([]))
            left = room - size - OPEN_BYTES
        splits[-1].files.append((file, size))
    return splits


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, small batches put together."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.num_rows > BATCH_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(batch)
        size += batch.num_rows
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _rows(**columns: list) -> pa.RecordBatch:
    """Rows with the given columns; the others are NULL."""
    size = len(columns["kind"])
    return pa.RecordBatch.from_pydict({name: columns.get(name, [None] * size) for name in ARROW.names}, schema=ARROW)


def _axis_rows(file: str, lat: np.ndarray, lon: np.ndarray) -> pa.RecordBatch:
    ny, nx = lat.size, lon.size
    return _rows(
        kind=[AXIS] * (ny + nx), file=[file] * (ny + nx), r=[*range(ny), *[None] * nx], c=[*[None] * ny, *range(nx)],
        lat=[*lat, *[None] * nx], lon=[*[None] * ny, *lon])


def _error_row(file: str, message: str) -> pa.RecordBatch:
    return _rows(kind=[ERROR], file=[file], error=[message])


@dataclass(frozen=True)
class GridRead:
    """``grid(frame, ts, r, c, lat, lon, tb, file)``, its full axes, frames, ``bad_files(file, error)`` and the number of files.

    ``step_class`` names the smallest step between frames, None for a single frame.
    """

    grid: DataFrame
    rows: DataFrame
    cols: DataFrame
    frames: DataFrame
    bad_files: DataFrame
    n_files: int
    step_class: str | None


def open_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """All rows of the source, to be filtered by a plain ``where``; ``fold=False`` leaves 0..360 longitudes as they are.

    The session's pushdown setting must be the same here and where the rows are read.
    """
    ship_package(spark)
    spark.dataSource.register(GridFiles)
    return spark.read.format("gridfiles").options(path=path, pushdown=spark.conf.get(PUSHDOWN, "false"), **options).load()


@contextmanager
def pushing(spark: SparkSession) -> Iterator[None]:
    """Inside, the session pushes filters into Python sources."""
    before = spark.conf.get(PUSHDOWN, "false")
    spark.conf.set(PUSHDOWN, "true")
    try:
        yield
    finally:
        spark.conf.set(PUSHDOWN, before)


def _decoded(spark: SparkSession, path: str, name: str, wanted: Column, **options) -> DataFrame:
    """Wanted rows of the source as a stage table: every slice is decoded once, whatever reads it later."""
    with pushing(spark):
        return stage(open_files(spark, path, **options).where(wanted), name)


def _constant(when: datetime) -> Column:
    return F.lit(when.isoformat(" ")).cast("timestamp_ntz")


def read_grid_files(spark: SparkSession, path: str, value_max: float | None = None, start: str | None = None, end: str | None = None,
                    margin: float = 0, file_hours: float | None = None, **options) -> GridRead:
    """Read grid files with decoded times; frames are numbered 1, 2, ... in time order.

    ``lat_min``, ``lat_max``, ``lon_min`` and ``lon_max`` with ``margin``, the axis steps to
    keep around them, and ``value_max``, which the whole part of a value may reach, bound the
    cells; ``start`` and ``end`` as ``yyyymmddHH`` bound the frames.  Headers are read first,
    and then the bands of rows that hold such cells.  A file that begins before
    ``start`` is opened to see what it spans, unless ``file_hours`` promises that
    no file spans more.

    Raises when two slices have the same time, or when frames are steps apart
    that no class of time steps knows.
    """
    bounds = {x: float(options.pop(x)) for x in ("lat_min", "lat_max", "lon_min", "lon_max") if x in options}
    if end is not None:
        options["named_until"] = end
    if start is not None and file_hours is not None:
        options["named_from"] = f"{_whole_hour(start) - timedelta(hours=float(file_hours)):%Y%m%d%H}"
    heads = _decoded(spark, path, "grid-heads", F.col("kind").isin(SLICE, AXIS, ERROR), **options)
    bad = heads.where(F.col("kind") == ERROR).select("file", "error").distinct()
    period = F.lit(True)
    if start is not None:
        period = period & (F.col("ts") >= _constant(_whole_hour(start)))
    if end is not None:
        period = period & (F.col("ts") < _constant(_whole_hour(end) + timedelta(hours=1)))
    slices = heads.where((F.col("kind") == SLICE) & period)
    frames = stage(number_frames(slices), "frames")
    doubled = slices.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).where("n > 1").first()
    if doubled:
        raise ValueError(f"{doubled.n} slices have the time {doubled.ts}, one of them in {doubled.file}")
    n_files, first = heads.agg(F.count_distinct("file"), F.min(F.when(F.col("kind") == AXIS, F.col("file")))).first()
    lines = stage(heads.where((F.col("kind") == AXIS) & (F.col("file") == first)).select("r", "lat", "c", "lon"), "axes")
    wanted = (F.col("kind") == CELL) & period
    if value_max is not None:
        wanted = wanted & (F.col("value") < float(math.floor(value_max) + 1))
    for axis, index in (("lat", "r"), ("lon", "c")):
        room = margin * _largest_step(lines, axis, index) if margin else 0.0
        if f"{axis}_min" in bounds:
            wanted = wanted & (F.col(axis) >= bounds[f"{axis}_min"] - room)
        if f"{axis}_max" in bounds:
            wanted = wanted & (F.col(axis) <= bounds[f"{axis}_max"] + room)
    grid = _decoded(spark, path, "grid-cells", wanted, **options).join(frames, "ts").select(
        "frame", "ts", "r", "c", "lat", "lon", F.col("value").alias("tb"), "file")
    return GridRead(
        grid, lines.where("r is not null").select("r", "lat"),
        lines.where("c is not null").select("c", normalize_longitude("lon").alias("lon")), frames, bad, n_files,
        _step_class(frames))


def _largest_step(lines: DataFrame, axis: str, index: str) -> float:
    """Largest step between neighbouring lines; the jump where longitudes are folded is no step."""
    own = lines.where(F.col(index).isNotNull()).select(index, F.col(axis).alias("at"))
    after = own.select((F.col(index) - 1).alias(index), F.col("at").alias("next"))
    step = F.abs(F.col("next") - F.col("at"))
    return float(own.join(after, index).where(step < 180).agg(F.coalesce(F.max(step), F.lit(0.0))).first()[0])


def _step_class(frames: DataFrame) -> str | None:
    """Class of the smallest step between two frames, by hours or, for longer ones, days."""
    after = frames.select((F.col("frame") - 1).alias("frame"), F.col("ts").alias("next"))
    seconds = F.unix_timestamp(F.col("next").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    hours = frames.join(after, "frame").agg(F.min(seconds / 3600).alias("hours")).where("hours is not null")
    kind = F.coalesce(
        time_step_class(F.lit("hours"), "hours", on_error="null"),
        time_step_class(F.lit("days"), F.col("hours") / 24, on_error="null"))
    found = hours.select("hours", kind.alias("kind")).first()
    if found is not None and found.kind is None:
        raise ValueError(f"time step not supported: {found.hours} hours")
    return found.kind if found else None


def number_frames(cells: DataFrame) -> DataFrame:
    """Frame numbers 1, 2, ... in time order."""
    times = cells.select("ts").distinct().withColumn("series", F.lit(0)).withColumn("day", F.to_date("ts"))
    return number_rows(times, "series", "day", ["ts"], "frame").select("frame", "ts")


@dataclass(frozen=True)
class RainRead:
    """``cells(ts, lat, lon, value)`` and ``bad_files(file, error)``."""

    cells: DataFrame
    bad_files: DataFrame
    n_files: int


def read_rain(spark: SparkSession, path: str, variable: str = "pcp", start: str | None = None, end: str | None = None,
              hours: float = 24, **options) -> RainRead:
    """The first slice of each file; the time is the file name's, and counts for ``hours`` after it."""
    if start is not None:
        options["named_from"] = f"{_whole_hour(start) - timedelta(hours=hours):%Y%m%d%H}"
    if end is not None:
        options["named_until"] = end
    options["variable"] = variable
    heads = _decoded(spark, path, "rain-heads", F.col("kind").isin(SLICE, ERROR), **options)
    cells = _decoded(spark, path, "rain-cells", (F.col("kind") == CELL) & (F.col("t") == 0), **options)
    name = F.element_at(F.split("file", "/"), -1)
    return RainRead(
        cells.select(file_time(name).alias("ts"), "lat", "lon", "value"),
        heads.where(F.col("kind") == ERROR).select("file", "error").distinct(),
        heads.agg(F.count_distinct("file")).first()[0])
