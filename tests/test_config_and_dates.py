import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridtrack.config import TrackConfig
from gridtrack.functions import dates
from gridtrack.functions.geo import edge_weight, normalize_longitude


def test_defaults_are_valid_and_reversed_temperatures_are_swapped():
    config = TrackConfig(t_bb_min=250, t_bb_max=210)
    assert (config.t_bb_min, config.t_bb_max) == (210, 250)
    assert config.end_time == datetime(2009, 8, 31, 21)


@pytest.mark.parametrize("change", [
    {"lat_min": -91}, {"lat_min": 20, "lat_max": 10}, {"lon_max": 181}, {"xres": 0}, {"lat_distance": 112},
    {"convective_fraction": 1.5}, {"min_mcs_duration": 2}, {"area_min": 0}, {"eccentricity_min": 1.1},
    {"inner_area": 90000}, {"inner_temperature": 240}, {"minimum_duration": 30}, {"start": "2009083122"},
    {"start": "20090831"}, {"element_mode": "hull"},
])
def test_bad_configuration_raises(change):
    with pytest.raises(ValueError):
        TrackConfig(**change)


def test_json_configuration(tmp_path):
    path = tmp_path / "run.json"
    path.write_text(json.dumps({
        "LATMIN": "4.5", "TRES": 1, "startDateTime": "2010010100", "endDateTime": "2010010212",
        "DIRS": {"CEoriDirName": "/data/ir", "TRMMdirName": "None", "mainDirStr": "/out"}}))
    config = TrackConfig.from_json(path)
    assert (config.lat_min, config.start, config.grid_dir, config.precip_dir) == (4.5, "2010010100", "/data/ir", None)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, expected", [
    ("2015-01-03 12:00", False), ("20150101", False), ("2015000100", False), ("2015010124", False),
    ("2015010100", True), ("201501010059", True), ("2015023000", False), ("", False),
])
def test_valid_date(spark, text, expected):
    assert one(spark, dates.valid_date(F.lit(text))) is expected


@pytest.mark.parametrize("hour, bucket", [(0, 0), (1, 0), (2, 0), (3, 3), (5, 3), (22, 21)])
def test_three_hour_floor(spark, hour, bucket):
    ts = F.lit(f"2009-08-31 {hour:02d}:30:00").cast("timestamp_ntz")
    assert one(spark, dates.floor_to_hours(ts)) == datetime(2009, 8, 31, bucket)


@pytest.mark.parametrize("unit, step, expected", [
    ("hours", 1, "hourly"), ("hours", 0, "hourly"), ("hours", 24, "daily"), ("hours", 700, "monthly"),
    ("hours", 8784, "annual"), ("minutes", 60, "hourly"), ("days", 366, "annual"), ("months", 12, "annual"),
    ("years", 1, "annual"), ("hours", 5, None),
])
def test_time_step_class(spark, unit, step, expected):
    assert one(spark, dates.time_step_class(F.lit(unit), F.lit(step), "null")) == expected


def test_unknown_time_step_raises(spark):
    with pytest.raises(Exception, match="time step not supported"):
        one(spark, dates.time_step_class(F.lit("hours"), F.lit(5)))


@pytest.mark.parametrize("units, offset, compat, expected", [
    ("hours since 2009-08-31 05", 3, False, datetime(2009, 8, 31, 8)),
    ("hours since 2009-08-31 05", 3, True, datetime(2009, 8, 31, 6)),
    ("hours since 2009-08-31 05", 20, True, datetime(2009, 9, 1, 1)),
    ("minutes since 2009-08-31 05:30", 45, False, datetime(2009, 8, 31, 6, 15)),
    ("months since 2009-08-31 00", 1, False, datetime(2009, 9, 30)),
    ("years since 2009-08-31 00:00:00.0", 2, False, datetime(2011, 8, 31)),
])
def test_model_times(spark, units, offset, compat, expected):
    assert one(spark, dates.decode_model_time(F.lit(units), F.lit(offset), compat)) == expected


def test_mean_time_of_day_does_not_wrap(spark):
    times = spark.createDataFrame([("2009-08-31 23:00:00",), ("2009-09-01 01:00:00",)], "t string")
    got = times.select(F.col("t").cast("timestamp_ntz").alias("t")).agg(dates.clock(dates.average_clock("t")).alias("x"))
    assert got.first()["x"] == "12:00:00"


def test_time_pattern_and_file_names(spark):
    assert one(spark, dates.fill_time_pattern(F.lit("200909011530"), F.lit("20090831*00*"))) == "20090901*15*"
    name = dates.element_file_name(F.lit("2009-08-31 04:00:00").cast("timestamp_ntz"), F.lit("F5CE12"))
    assert one(spark, name) == "cloudElements2009-08-31_04:00:00F5CE12.nc"
    assert tuple(one(spark, dates.parse_element_file(name))) == (datetime(2009, 8, 31, 4), 5, 12)


@pytest.mark.parametrize("lon, expected", [(181.0, -179.0), (180.0, 180.0), (359.5, -0.5), (-5.0, -5.0)])
def test_longitudes(spark, lon, expected):
    assert one(spark, normalize_longitude(F.lit(lon))) == expected


@pytest.mark.parametrize("n, before, after, weight", [(4, 4, 10, 1), (19, 20, 40, 1), (18, 20, 40, 2), (3, 10, 10, 3), (2, 10, 10, None)])
def test_edge_weights(spark, n, before, after, weight):
    assert one(spark, edge_weight(F.lit(max(n / before, n / after)), F.lit(n * 16.0), 48)) == weight
