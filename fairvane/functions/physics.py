"""Meteorological and geometric scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_KM, EARTH_RADIUS_REFERENCE_KM

#: Lapse rate (K/m), gravity over gas constant and lapse rate, and their inverse form.
LAPSE, EXPONENT = 0.0065, 9.80665 * 0.0289644 / (8.31447 * 0.0065)


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    return F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, in the arctangent form."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def distance_km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """``haversine_km`` of plain numbers, for state that lives in a task."""
    dlat, dlon = math.radians(lat2 - lat1) / 2, math.radians(lon2 - lon1) / 2
    a = math.sin(dlat) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(dlon) ** 2
    return 2 * EARTH_RADIUS_KM * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))


def reference_distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, in the arcsine form with the mean radius."""
    return F.lit(2 * EARTH_RADIUS_REFERENCE_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), _half_chord(lat1, lon1, lat2, lon2))))


def clip(value: Column, low: float, high: float) -> Column:
    """The value held to a range; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def dew_point(temperature: Column, humidity: Column) -> Column:
    """Magnus dew point with constants 17.27 and 237.7; humidity held to 0.01-100 %."""
    g = F.lit(17.27) * temperature / (F.lit(237.7) + temperature) + F.log(clip(humidity, 0.01, 100.0) / 100)
    return F.lit(237.7) * g / (F.lit(17.27) - g)


def display_dew_point(temperature: Column, humidity: Column) -> Column:
    """Dew point for display (17.62, 243.12); null unless humidity is in (0, 100]."""
    g = F.log(humidity / 100) + F.lit(17.62) * temperature / (F.lit(243.12) + temperature)
    return F.when((humidity > 0) & (humidity <= 100), F.lit(243.12) * g / (F.lit(17.62) - g))


def humidity_from_dew_point(temperature: Column, dew: Column) -> Column:
    """Relative humidity from temperature and dew point (17.625, 243.04), within 0-100 %."""

    def e(t: Column) -> Column:
        return F.exp(F.lit(17.625) * t / (F.lit(243.04) + t))

    return clip(100 * e(dew) / e(temperature), 0.0, 100.0)


def hypsometric_pressure(elevation: Column, sea_level: float = 1013.25, kelvin: float = 288.15) -> Column:
    return F.lit(sea_level) * F.pow(1 - F.lit(LAPSE) * elevation / kelvin, F.lit(EXPONENT))


def hypsometric_score(pressure: Column, elevation: Column, tolerance: float = 8.0) -> Column:
    """0.85 where station pressure above 50 m is further than the tolerance from its height's."""
    expected = hypsometric_pressure(elevation)
    off = F.abs(pressure - expected) / expected * 100
    return F.when((elevation > 50) & (off > tolerance), 0.85).otherwise(0.0)


def to_sea_level(pressure: Column, elevation: Column, celsius: Column) -> Column:
    return pressure * F.pow(1 + F.lit(LAPSE) * elevation / (celsius + 273.15), F.lit(EXPONENT))


def elevation_proxy(pressure: Column, sea_level: float = 1013.25, kelvin: float = 288.15) -> Column:
    height = (1 - F.pow(pressure / sea_level, F.lit(1 / EXPONENT))) * kelvin / LAPSE
    return F.greatest(F.lit(0.0), height)


def robust_z(value: Column, median: Column, mad: Column, floor: float) -> Column:
    """Deviation in robust standard deviations, the spread held to a floor."""
    return (value - median) / F.greatest(mad * 1.4826, F.lit(floor))


def evidence(value: Column, center: float, threshold: float, extreme: float) -> Column:
    """0 up to the centre, 0.5 at the threshold, 1 from the extreme on, linear between."""
    low = (value - center) / (threshold - center) * 0.5
    high = 0.5 + (value - threshold) / (extreme - threshold) * 0.5
    return F.when(value <= center, 0.0).when(value >= extreme, 1.0).when(value <= threshold, low).otherwise(high)


def clausius_score(temperature: Column, humidity: Column) -> Column:
    return F.when((temperature > 32) & (humidity > 95), 0.85).otherwise(0.0)


def spatial_raw_score(z: Column, neighbours: Column) -> Column:
    """Score of a neighbour z, capped by how many neighbours support it."""
    cap = F.when(neighbours >= 5, 1.0).when(neighbours >= 3, 0.75).otherwise(0.5)
    return F.when(z > 3, F.least(F.least(F.lit(1.0), (z - 3) / 3 + 0.5), cap)).otherwise(0.0)


def cardinal(degrees: Column) -> Column:
    """16-point compass name; CALM without a direction."""
    names = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
    at = F.pmod(F.floor(degrees / 22.5 + 0.5), F.lit(16)).cast("int")
    return F.when(degrees.isNull(), "CALM").otherwise(F.get(F.array(*[F.lit(n) for n in names]), at))


def wet_bulb(temperature: Column, humidity: Column) -> Column:
    """Wet-bulb temperature at sea-level pressure by the published arctangent fit (Stull 2011)."""
    t, h = temperature, clip(humidity, 5.0, 99.0)
    return (
        t * F.atan(0.151977 * F.sqrt(h + 8.313659))
        + F.atan(t + h)
        - F.atan(h - 1.676331)
        + 0.00391838 * F.pow(h, 1.5) * F.atan(0.023101 * h)
        - 4.686035
    )


def wet_bulb_veto(temperature: Column, humidity: Column, limit: float = 35.0) -> Column:
    """Whether the wet bulb exceeds what people survive; null readings veto nothing."""
    return F.coalesce(wet_bulb(temperature, humidity) > limit, F.lit(False))
