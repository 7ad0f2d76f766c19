"""Discovery of time-stamped files and of gaps in a series."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: step units of a file series
UNITS = {"minute": "minute", "hour": "hour", "day": "day", "month": "month"}


def file_time(name: Column | str) -> Column:
    """Time in a file name: ``yyyymmdd`` with optional hour and minute, delimiters allowed; NULL if none."""
    name = F.col(name) if isinstance(name, str) else name
    pattern = r"(?:^|[^0-9])(\d{8})[_.,-]?(\d{2})?[_.,-]?(\d{2})?(?:[^0-9]|$)"
    digits = F.concat(
        F.regexp_extract(name, pattern, 1), F.rpad(F.concat(
            F.regexp_extract(name, pattern, 2), F.regexp_extract(name, pattern, 3)), 4, "0"))
    full = F.try_to_timestamp(digits, F.lit("yyyyMMddHHmm"))
    month = F.try_to_timestamp(
        F.regexp_extract(name, r"(?:^|[^0-9])(\d{6})(?:[^0-9]|$)", 1), F.lit("yyyyMM"))
    return F.coalesce(full, month).cast("timestamp_ntz")


def list_files(spark: SparkSession, directory: str, pattern: str = "*.nc") -> DataFrame:
    """``(path, name, ts)`` of the non-empty files in a directory; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), file_time(name).alias("ts"))


def expected_times(spark: SparkSession, start: datetime, end: datetime, step: int, unit: str) -> DataFrame:
    """``start, start + step, ... <= end``."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    first, last = (F.lit(t.isoformat(" ")).cast("timestamp_ntz") for t in (start, end))
    return spark.range(1).select(
        F.explode(F.sequence(first, last, F.expr(f"interval '{int(step)}' {unit}"))).alias("ts"))


def missing_times(files: DataFrame, expected: DataFrame, unit: str = "hour") -> DataFrame:
    """Expected times without a file."""
    present = files.where(F.col("ts").isNotNull()).select(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts"))
    return expected.join(present, "ts", "left_anti")


def check_files(spark: SparkSession, directory: str, start: datetime, end: datetime, step: int,
                unit: str = "hour", pattern: str = "*.nc") -> tuple[DataFrame, DataFrame]:
    """Files of the period and the expected times that have none."""
    files = list_files(spark, directory, pattern)
    in_period = files.where(F.col("ts").between(
        F.lit(start.isoformat(" ")).cast("timestamp_ntz"), F.lit(end.isoformat(" ")).cast("timestamp_ntz")))
    return in_period, missing_times(files, expected_times(spark, start, end, step, unit), unit)
