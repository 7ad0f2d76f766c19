"""Header and slice reading of classic netCDF files (CDF-1, CDF-2).

Only what a gridded time series needs: dimensions, attributes, and one record
of one variable at a time.  The layout is the published classic format.

Two conventions of the CF metadata that keep large grids small are known, both without loss
here: compression by gathering (only some cells of a grid are stored, with their places), and
axes by tie points (lines between two tie points lie evenly).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from math import prod

import numpy as np

# fixed values: external types of the classic format (code: big-endian array type)
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12


@dataclass(frozen=True)
class Variable:
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: str
    attributes: dict
    begin: int
    by_record: bool


@dataclass(frozen=True)
class Axis:
    """An axis of ``size`` lines by tie points, or with all lines where ``index`` is None."""

    value: np.ndarray
    size: int
    index: np.ndarray | None = None

    def at(self, lines: np.ndarray) -> np.ndarray:
        return self.value[lines] if self.index is None else between_ties(self.index, self.value, lines)

    def whole(self) -> np.ndarray:
        return self.value if self.index is None else self.at(np.arange(self.size))


def between_ties(index: np.ndarray, value: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Coordinates of ``lines``: the value of a tie point, or evenly between those before and behind."""
    low = np.searchsorted(index, lines, "right") - 1
    high = np.minimum(low + 1, index.size - 1)
    with np.errstate(invalid="ignore", over="ignore"):
        step = (value[high] - value[low]) / np.maximum(index[high] - index[low], 1)
        return np.where(lines == index[low], value[low], value[low] + (lines - index[low]) * step)


def tie_points(axis: np.ndarray) -> np.ndarray:
    """Lines from which ``between_ties`` gives back every value of the axis to the bit."""

    def exact(low: int, high: int) -> bool:
        ends = np.array([low, high])
        found = between_ties(ends, axis[ends], np.arange(low, high + 1))
        return found.tobytes() == axis[low: high + 1].tobytes()

    ties, low = [], 0
    while low < axis.size:
        high, width = low, 1
        while width and high < axis.size - 1:
            reach = min(high + width, axis.size - 1)
            if exact(low, reach):
                high, width = reach, width * 2
            else:
                width //= 2
        ties += [low] if high == low else [low, high]
        low = high + 1
    return np.array(ties, dtype=np.int64)


class ClassicFile:
    """An open classic file; ``handle`` is any seekable binary file."""

    def __init__(self, handle) -> None:
        self.handle = handle
        magic = handle.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError("not a classic netCDF file")
        self._offset = ">i" if magic[3] == 1 else ">q"
        self.records = max(self._int(), 0)
        dims = self._items(DIMENSIONS, lambda: (self._name(), self._int()))
        self.attributes = self._attributes()
        self.dims = dict(dims)
        raw = self._items(VARIABLES, self._variable)
        self.variables, self._record_bytes = self._shape(dims, raw)

    def _int(self) -> int:
        return struct.unpack(">i", self.handle.read(4))[0]

    def _padded(self, size: int) -> bytes:
        data = self.handle.read(size)
        self.handle.read(-size % 4)
        return data

    def _name(self) -> str:
        return self._padded(self._int()).decode("utf-8")

    def _items(self, tag: int, read_one) -> list:
        found, count = self._int(), self._int()
        if count and found != tag:
            raise ValueError("damaged netCDF header")
        return [read_one() for _ in range(count)]

    def _attribute(self):
        name, code, count = self._name(), self._int(), self._int()
        dtype = np.dtype(TYPES[code])
        data = self._padded(count * dtype.itemsize)
        return name, data.decode("utf-8", "replace").rstrip("\0") if code == 2 else np.frombuffer(data, dtype)

    def _attributes(self) -> dict:
        return dict(self._items(ATTRIBUTES, self._attribute))

    def _variable(self):
        name, rank = self._name(), self._int()
        dims = [self._int() for _ in range(rank)]
        attributes, code, _ = self._attributes(), self._int(), self._int()
        begin = struct.unpack(self._offset, self.handle.read(struct.calcsize(self._offset)))[0]
        return name, dims, attributes, TYPES[code], begin

    def _shape(self, dims, raw):
        variables = {}
        for name, ids, attributes, dtype, begin in raw:
            by_record = bool(ids) and dims[ids[0]][1] == 0
            shape = tuple(self.records if dims[i][1] == 0 else dims[i][1] for i in ids)
            variables[name] = Variable(
                tuple(dims[i][0] for i in ids), shape, dtype, attributes, begin, by_record)
        sizes = [_record_size(v) for v in variables.values() if v.by_record]
        stride = sizes[0] if len(sizes) == 1 else sum(size + -size % 4 for size in sizes)
        return variables, stride

    def whole(self, name: str) -> np.ndarray:
        """A variable as one array; meant for axes and the time variable."""
        variable = self.variables[name]
        if variable.by_record:
            return np.concatenate([self.record(name, i)[None] for i in range(self.records)])
        return self._read(variable, variable.begin, variable.shape)

    def record(self, name: str, index: int) -> np.ndarray:
        """Slice ``index`` along the first dimension."""
        variable = self.variables[name]
        return self._read(variable, self._place(variable, index), variable.shape[1:])

    def rows(self, name: str, index: int, first: int, last: int) -> np.ndarray:
        """Rows ``first`` to ``last`` (exclusive) of slice ``index``; no other byte is read."""
        variable = self.variables[name]
        inner = variable.shape[2:]
        skipped = first * prod(inner) * np.dtype(variable.dtype).itemsize
        return self._read(variable, self._place(variable, index) + skipped, (last - first, *inner))

    def gathered(self, name: str) -> tuple[np.ndarray, tuple[int, ...]] | None:
        """Places of the stored cells in the grid of ``name``, and that grid's shape; None if all cells are stored."""
        places = self.variables.get(self.variables[name].dims[-1])
        if places is None or "compress" not in places.attributes:
            return None
        shape = tuple(self.dims[x] for x in places.attributes["compress"].split())
        if len(shape) != 2:
            raise ValueError(f"cells gathered from {len(shape)} dimensions")
        return self.whole(self.variables[name].dims[-1]).astype(np.int64), shape

    def axis(self, name: str, grid: str) -> Axis:
        """Coordinates ``name`` of the variable ``grid``."""
        value = self.whole(name).astype(float)
        rules = self.variables[grid].attributes.get("coordinate_interpolation", "").split()
        rule = dict(zip(rules[::2], rules[1::2])).get(f"{name}:")
        if rule is None:
            return Axis(value, value.size)
        about = self.variables[rule].attributes
        if about["interpolation_name"] != "linear":
            raise ValueError(f"axis {name} by {about['interpolation_name']} interpolation")
        dimension, index, _ = about["tie_point_mapping"].split()
        return Axis(value, self.dims[dimension.removesuffix(":")], self.whole(index).astype(np.int64))

    def end(self, name: str, index: int) -> int:
        """Offset behind the last byte of slice ``index``."""
        variable = self.variables[name]
        return self._place(variable, index) + _record_size(variable)

    def _place(self, variable: Variable, index: int) -> int:
        return variable.begin + index * (self._record_bytes if variable.by_record else _record_size(variable))

    def _read(self, variable: Variable, begin: int, shape: tuple[int, ...]) -> np.ndarray:
        dtype = np.dtype(variable.dtype)
        self.handle.seek(begin)
        data = self.handle.read(prod(shape) * dtype.itemsize)
        return np.frombuffer(data, dtype).reshape(shape).astype(dtype.newbyteorder("="))


def _record_size(variable: Variable) -> int:
    return prod(variable.shape[1:]) * np.dtype(variable.dtype).itemsize
