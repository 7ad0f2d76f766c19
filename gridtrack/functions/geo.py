"""Column expressions on coordinates, shapes and region classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_longitude(lon: Column | str) -> Column:
    """Fold 0..360 longitudes into -180..180."""
    lon = _col(lon)
    return F.when(lon > 180, lon - 360).otherwise(lon)


def eccentricity(height: Column | str, width: Column | str) -> Column:
    """Box shape: near 1 for a square box, near 0 for a line."""
    ny, nx = _col(height), _col(width)
    softening = F.lit(0.001)
    return F.least(nx / (ny + softening), ny / (nx + softening))


def edge_weight(pct: Column | str, area: Column | str, min_overlap: float) -> Column:
    """Class of an overlap: 1 and 2 by share, 3 by area, NULL when there is no link."""
    pct, area = _col(pct), _col(area)
    return (
        F.when(pct >= 0.95, 1)
        .when(pct >= 0.90, 2)
        .when(area >= min_overlap, 3)
    )


def size_class(area: Column | str) -> Column:
    """Marker class of the area chart."""
    area = _col(area)
    return F.when(area < 80000, "small").when(area < 160000, "medium").otherwise("large")


def ratio_speed(lat: Column, lon: Column, lat2: Column, lon2: Column,
                lat_distance: float, tres: float) -> Column:
    """Speed as the published metric defines it: the slope of the displacement, not its length.

    A zero difference counts as 1 degree.
    """
    def step(a: Column, b: Column) -> Column:
        gap = a - b
        return F.when(gap == 0, F.lit(1.0)).otherwise(gap)

    return F.abs(step(lat, lat2) / step(lon, lon2) * lat_distance * 1000 / (tres * 3600))
