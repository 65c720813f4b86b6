"""Readings and times out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _with_unit(text: Column, unit: str, sign: str = "") -> Column:
    """The number before ``unit`` at the start of the text, or null."""
    found = F.regexp_extract(text, rf"(?i)^({sign}\d+(?:\.\d+)?)\s*{unit}", 1)
    return F.when(found != "", found.cast("double"))


def _bare(text: Column) -> Column:
    return text.try_cast("double")


def temperature_reading(text: Column) -> Column:
    """Degrees Celsius from a number with C, F or no unit, to one decimal."""
    t = F.trim(text)
    return F.round(F.coalesce(_with_unit(t, "C", "-?"), (_with_unit(t, "F", "-?") - 32) * 5 / 9, _bare(t)), 1)


def humidity_reading(text: Column) -> Column:
    """Whole per cent."""
    t = F.trim(text)
    return F.bround(F.coalesce(_with_unit(t, "%"), _bare(t)), 0).cast("int")


def wind_reading(text: Column) -> Column:
    """Kilometres an hour from km/h, mph, m/s, knots or no unit, to one decimal."""
    t = F.trim(text)
    return F.round(
        F.coalesce(
            _with_unit(t, "kmh"), _with_unit(t, "mph") * 1.60934, _with_unit(t, "m/s") * 3.6, _with_unit(t, "kts") * 1.852, _bare(t)
        ),
        1,
    )


def pressure_reading(text: Column) -> Column:
    """Hectopascals from hPa or mb, inches of mercury or no unit, to one decimal."""
    t = F.trim(text)
    return F.round(F.coalesce(_with_unit(t, "(?:hPa|mb)"), _with_unit(t, "inHg") * 33.8639, _bare(t)), 1)


def any_time(text: Column) -> Column:
    """A time from ISO 8601, an HTTP date or seconds since the epoch; null if it is none of these."""
    t = F.trim(text)
    http = F.try_to_timestamp(F.regexp_extract(t, r"^[A-Za-z]{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    epoch = F.when(t.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_micros((t.try_cast("double") * 1e6).cast("long")))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t))
    return F.coalesce(epoch, F.when(t.rlike(r"^[A-Za-z]{3}, .* GMT$"), http), iso)
