"""Run configuration.

All thresholds of a run live in one frozen dataclass that is handed to the
operators and ends up as literals in the plan.  Validation raises instead of
printing, so a bad configuration never reaches the cluster.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from datetime import datetime
from pathlib import Path

ELEMENT_MODES = ("bbox", "component")
PATH_RULES = ("last_within_length", "min_distance")


def parse_run_time(text: str) -> datetime:
    """Parse ``yyyymmddHH`` or ``yyyymmddHHMM``; raise ``ValueError`` otherwise."""
    formats = {10: "%Y%m%d%H", 12: "%Y%m%d%H%M"}
    if not text.isdigit() or len(text) not in formats:
        raise ValueError(f"not a yyyymmddHH[MM] time: {text!r}")
    return datetime.strptime(text, formats[len(text)])


@dataclass(frozen=True)
class TrackConfig:
    # fixed values: the published default domain, period and thresholds
    lat_min: float = 5.0
    lat_max: float = 19.0
    lon_min: float = -5.0
    lon_max: float = 9.0
    start: str = "200908310000"
    end: str = "200908312100"
    xres: float = 4.0
    yres: float = 4.0
    tres: float = 1.0
    lat_distance: float = 111.0
    lon_distance: float = 111.0
    t_bb_max: float = 243.0
    t_bb_min: float = 218.0
    convective_fraction: float = 0.90
    min_mcs_duration: float = 3.0
    area_min: float = 2400.0
    min_overlap: float = 10000.0
    eccentricity_min: float = 0.70
    eccentricity_max: float = 1.0
    outer_area: float = 80000.0
    inner_area: float = 30000.0
    outer_temperature: float = 233.0
    inner_temperature: float = 213.0
    minimum_duration: float = 6.0
    maximum_duration: float = 24.0
    grid_dir: str | None = None
    precip_dir: str | None = None
    output_dir: str | None = None
    # engine choices, not science
    element_mode: str = "bbox"
    path_rule: str = "last_within_length"
    require_contiguous_time: bool = False
    tile: int = 512
    frames_per_round: int = 64
    page_nodes: int = 250_000
    max_bad_share: float = 0.5
    rain_tolerance: float | None = None
    netcdf_products: bool = False
    fold_longitudes: bool = True

    def __post_init__(self) -> None:
        for item in fields(self):
            if item.type == "float":
                object.__setattr__(self, item.name, float(getattr(self, item.name)))
        if self.t_bb_min > self.t_bb_max:
            low, high = self.t_bb_max, self.t_bb_min
            object.__setattr__(self, "t_bb_min", low)
            object.__setattr__(self, "t_bb_max", high)
        checks = {
            "latitudes must satisfy -90 <= min <= max <= 90":
                -90 <= self.lat_min <= self.lat_max <= 90,
            "longitudes must satisfy -180 <= min <= max <= 180":
                -180 <= self.lon_min <= self.lon_max <= 180,
            "start must not be after end":
                parse_run_time(self.start) <= parse_run_time(self.end),
            "resolutions must be positive": min(self.xres, self.yres, self.tres) > 0,
            "degree lengths must be in (0, 111] km":
                0 < self.lat_distance <= 111 and 0 < self.lon_distance <= 111,
            "convective_fraction must be in [0, 1]": 0 <= self.convective_fraction <= 1,
            "min_mcs_duration must be at least 3": self.min_mcs_duration >= 3,
            "area_min must be positive": self.area_min > 0,
            "eccentricities must satisfy 0 <= min <= max <= 1":
                0 <= self.eccentricity_min <= self.eccentricity_max <= 1,
            "inner_area must not exceed outer_area": self.inner_area <= self.outer_area,
            "inner_temperature must not exceed outer_temperature":
                self.inner_temperature <= self.outer_temperature,
            "minimum_duration must not exceed maximum_duration":
                self.minimum_duration <= self.maximum_duration,
            f"element_mode must be one of {ELEMENT_MODES}": self.element_mode in ELEMENT_MODES,
            f"path_rule must be one of {PATH_RULES}": self.path_rule in PATH_RULES,
            "tile must be at least 2": self.tile >= 2,
            "frames_per_round and page_nodes must be positive": self.frames_per_round > 0 and self.page_nodes > 0,
            "rain_tolerance must be positive": self.rain_tolerance is None or self.rain_tolerance > 0,
            "max_bad_share must be in [0, 1]": 0 <= self.max_bad_share <= 1,
        }
        broken = [message for message, ok in checks.items() if not ok]
        if broken:
            raise ValueError("; ".join(broken))

    @property
    def cell_area(self) -> float:
        return self.xres * self.yres

    @property
    def start_time(self) -> datetime:
        return parse_run_time(self.start)

    @property
    def end_time(self) -> datetime:
        return parse_run_time(self.end)

    def with_options(self, **changes) -> TrackConfig:
        return replace(self, **changes)

    @classmethod
    def from_json(cls, path: str | Path) -> TrackConfig:
        """Load the 26-key JSON configuration file."""
        raw = json.loads(Path(path).read_text())
        # fixed values: key names of the configuration file
        keys = {
            "LATMIN": "lat_min", "LATMAX": "lat_max", "LONMIN": "lon_min", "LONMAX": "lon_max",
            "startDateTime": "start", "endDateTime": "end",
            "XRES": "xres", "YRES": "yres", "TRES": "tres",
            "LAT_DISTANCE": "lat_distance", "LON_DISTANCE": "lon_distance",
            "T_BB_MAX": "t_bb_max", "T_BB_MIN": "t_bb_min",
            "CONVECTIVE_FRACTION": "convective_fraction",
            "MIN_MCS_DURATION": "min_mcs_duration",
            "AREA_MIN": "area_min", "MIN_OVERLAP": "min_overlap",
            "ECCENTRICITY_THRESHOLD_MIN": "eccentricity_min",
            "ECCENTRICITY_THRESHOLD_MAX": "eccentricity_max",
            "OUTER_CLOUD_SHIELD_AREA": "outer_area", "INNER_CLOUD_SHIELD_AREA": "inner_area",
            "OUTER_CLOUD_SHIELD_TEMPERATURE": "outer_temperature",
            "INNER_CLOUD_SHIELD_TEMPERATURE": "inner_temperature",
            "MINIMUM_DURATION": "minimum_duration", "MAXIMUM_DURATION": "maximum_duration",
        }
        text_fields = {f.name for f in fields(cls) if f.type == "str"}
        values = {}
        for key, name in keys.items():
            if key in raw:
                values[name] = str(raw[key]) if name in text_fields else float(raw[key])
        dirs = raw.get("DIRS", {})
        for key, name in (("CEoriDirName", "grid_dir"), ("TRMMdirName", "precip_dir"),
                          ("mainDirStr", "output_dir")):
            value = dirs.get(key)
            values[name] = None if value in (None, "", "None") else value
        return cls(**values)
