"""Column expressions on times, time strings and file names."""

from __future__ import annotations

import calendar
import math
import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def valid_date(text: Column | str) -> Column:
    """True for an existing ``yyyymmddHH`` or ``yyyymmddHHMM`` time."""
    text = _col(text)
    padded = F.when(F.length(text) == 10, F.concat(text, F.lit("00"))).otherwise(text)
    digits = text.rlike("^([0-9]{10}|[0-9]{12})$")
    parsed = F.try_to_timestamp(F.when(digits, padded), F.lit("yyyyMMddHHmm"))
    return F.coalesce(digits & parsed.isNotNull(), F.lit(False))


def floor_to_hours(ts: Column | str, hours: int = 3) -> Column:
    """Start of the ``hours``-wide bucket of the day that holds ``ts``."""
    ts = _col(ts)
    day = F.date_trunc("day", ts).cast("timestamp_ntz")
    bucket = F.floor(F.hour(ts) / hours) * hours
    return day + F.make_dt_interval(hours=bucket.cast("int"))


# fixed values: allowed step lengths (low, high, class) per time unit
STEP_CLASSES = {
    "minutes": [(60, 60, "hourly"), (1440, 1440, "daily"), (40320, 44640, "monthly"), (525600, 527040, "annual")],
    "hours": [(0, 1, "hourly"), (24, 24, "daily"), (672, 744, "monthly"), (8760, 8784, "annual")],
    "days": [(1, 1, "daily"), (28, 31, "monthly"), (365, 366, "annual")],
    "months": [(1, 1, "monthly"), (12, 12, "annual")],
    "years": [(1, 1, "annual")],
}


def time_step_class(unit: Column | str, step: Column | str, on_error: str = "raise") -> Column:
    """Class of a time step; unknown lengths raise, or give NULL with ``on_error='null'``."""
    unit, step = _col(unit), _col(step)
    result = None
    for name, ranges in STEP_CLASSES.items():
        for low, high, label in ranges:
            test = (unit == name) & step.between(low, high)
            result = F.when(test, label) if result is None else result.when(test, label)
    if on_error == "raise":
        message = F.concat(F.lit("time step not supported: "), step.cast("string"), F.lit(" "), unit)
        result = result.otherwise(F.raise_error(message).cast("string"))
    return result


def decode_base_time(text: Column | str) -> Column:
    """Timestamp of a base-time string; seconds fractions are ignored, NULL if undecodable."""
    text = F.trim(F.split_part(_col(text), F.lit("."), F.lit(1)))
    # fixed values: accepted base-time formats, most specific first
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HHmm", "yyyy-MM-dd HH", "yyyy-MM-dd"]
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


def time_unit(units: Column | str) -> Column:
    """The unit word of ``'<unit> since <date>'``."""
    return F.regexp_extract(_col(units), "(minutes|hours|days|months|years)", 1)


def decode_model_time(units: Column | str, offset: Column | str, compat_offsets: bool = False) -> Column:
    """Time of ``offset`` in ``'<unit> since <date>'``.

    Minutes, hours and days may have a fraction, kept to the microsecond; months
    and years are whole.  ``compat_offsets`` repeats the published reader, which
    drops fractions and takes every offset that is no multiple of 10 as 1.
    """
    base = decode_base_time(F.regexp_extract(_col(units), r"since\s*(.*)$", 1))
    unit = time_unit(units)
    x = _col(offset).cast("double")
    if compat_offsets:
        x = x.cast("bigint")
        x = F.when(x % 10 != 0, F.lit(1)).otherwise(x).cast("double")
    whole = x.cast("int")
    total = x * F.when(unit == "minutes", 60).when(unit == "hours", 3600).otherwise(86400)
    days = F.floor(total / 86400)
    seconds = F.round(total - days * 86400, 6)
    return (
        F.when(unit.isin("minutes", "hours", "days"),
               base + F.make_dt_interval(days=days.cast("int"), secs=seconds.cast("decimal(18,6)")))
        .when(unit == "months", base + F.make_ym_interval(months=whole))
        .when(unit == "years", base + F.make_ym_interval(years=whole))
    )


def model_time(units: str, offset: float) -> datetime | None:
    """The time that ``decode_model_time`` gives, for a header that a task has read."""
    found = re.search(r"since\s*(.*)$", units)
    base = _base_time(found[1]) if found else None
    unit = re.search("minutes|hours|days|months|years", units)
    if base is None or unit is None or not math.isfinite(offset):
        return None
    try:
        if unit[0] in ("months", "years"):
            months = base.year * 12 + base.month - 1 + int(offset) * (12 if unit[0] == "years" else 1)
            year, month = divmod(months, 12)
            day = min(base.day, calendar.monthrange(year, month + 1)[1])
            return base.replace(year=year, month=month + 1, day=day)
        total = offset * {"minutes": 60, "hours": 3600, "days": 86400}[unit[0]]
        days = math.floor(total / 86400)
        return base + timedelta(days=days, microseconds=round(round(total - days * 86400, 6) * 1e6))
    except (OverflowError, ValueError):
        return None


def _base_time(text: str) -> datetime | None:
    text = text.split(".")[0].strip()
    # fixed values: accepted base-time formats, with the length of their text
    for form, size in (("%Y-%m-%d %H:%M:%S", 19), ("%Y-%m-%d %H:%M", 16), ("%Y-%m-%d %H%M", 15), ("%Y-%m-%d %H", 13), ("%Y-%m-%d", 10)):
        if len(text) == size:
            try:
                return datetime.strptime(text, form)
            except ValueError:
                continue
    return None


def second_of_day(ts: Column | str) -> Column:
    ts = _col(ts)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def clock(seconds: Column | str) -> Column:
    """``HH:MM:SS`` of a second of the day."""
    s = _col(seconds)
    parts = (F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.format_string("%02d:%02d:%02d", *[p.cast("bigint") for p in parts])


def average_clock(ts: Column | str) -> Column:
    """Aggregate: mean time of day in whole seconds, without wrapping at midnight."""
    return F.floor(F.avg(second_of_day(ts)))


def fill_time_pattern(time_text: Column | str, pattern: Column | str) -> Column:
    """Cut ``time_text`` into the pieces of a ``*``-separated pattern, each followed by ``*``."""
    text, pieces = _col(time_text), F.filter(F.split(_col(pattern), r"\*"), lambda p: F.length(p) > 0)
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        pieces, start,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"], F.length(p)), F.lit("*")).alias("out")),
        lambda acc: acc["out"],
    )


def element_file_name(ts: Column | str, element: Column | str, prefix: str = "cloudElements") -> Column:
    """Name under which an element's grid is published."""
    return F.concat(F.lit(prefix), F.date_format(_col(ts), "yyyy-MM-dd_HH:mm:ss"), _col(element), F.lit(".nc"))


def parse_element_file(name: Column | str) -> Column:
    """Struct ``(ts, frame, ce_no)`` of an element file name."""
    name = _col(name)
    pattern = r"(\d{4}-\d{2}-\d{2}_\d{2}:\d{2}:\d{2})F(\d+)CE(\d+)"
    stamp = F.regexp_replace(F.regexp_extract(name, pattern, 1), "_", " ")
    return F.struct(
        F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("ts"),
        F.try_to_number(F.regexp_extract(name, pattern, 2), F.lit("999999999")).cast("int").alias("frame"),
        F.try_to_number(F.regexp_extract(name, pattern, 3), F.lit("999999999")).cast("int").alias("ce_no"),
    )
