"""Normalisation of inbound observations: units, ids, quality, rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FUTURE_MINUTES, LATE_HOURS, MAX_MAGNITUDE

#: Factor and offset of each unit that a parameter may come in.
UNITS: dict[str, dict[str, tuple[float, float]]] = {
    "temperature": {"C": (1.0, 0.0), "F": (5 / 9, -160 / 9), "K": (1.0, -273.15), "C10": (0.1, 0.0)},
    "humidity": {"pct": (1.0, 0.0), "fraction": (100.0, 0.0)},
    "pressure": {
        "hPa": (1.0, 0.0),
        "Pa": (0.01, 0.0),
        "kPa": (10.0, 0.0),
        "inHg": (33.8638866667, 0.0),
        "mmHg": (1.33322368, 0.0),
    },
    "wind_speed": {"km/h": (1.0, 0.0), "m/s": (3.6, 0.0), "kt": (1.852, 0.0), "mph": (1.609344, 0.0)},
    "rainfall": {"mm": (1.0, 0.0), "in": (25.4, 0.0), "cm": (10.0, 0.0)},
}


def converted(parameter: str, value: Column, unit: Column) -> Column:
    """The value in the canonical unit; null where the unit is unknown."""
    out = None
    for name, (factor, offset) in UNITS[parameter].items():
        then = value * F.lit(factor) + F.lit(offset)
        out = F.when(unit == name, then) if out is None else out.when(unit == name, then)
    return out


def unit_known(parameter: str, unit: Column) -> Column:
    return unit.isin(*UNITS[parameter])


def observation_id(station: Column, source: Column, observed_at: Column) -> Column:
    """obs_ and 20 hexadecimal digits of sha1(station|source|ISO time in UTC)."""
    iso = F.concat(F.date_format(observed_at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return F.concat(F.lit("obs_"), F.substring(F.sha1(F.concat_ws("|", station, source, iso)), 1, 20))


def usable(value: Column) -> Column:
    """A finite number of ordinary size."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) <= MAX_MAGNITUDE)


def quality_flags(values: dict[str, Column], observed_at: Column, received_at: Column, core: tuple[str, ...]) -> Column:
    """MISSING_x for each absent channel, NO_CORE_CHANNELS, LATE_ARRIVAL."""
    flags = [F.when(c.isNull(), f"MISSING_{n.upper()}") for n, c in values.items()]
    none = F.lit(True)
    for n in core:
        none = none & values[n].isNull()
    late = received_at - observed_at > F.expr(f"INTERVAL {LATE_HOURS} HOURS")
    return F.array_compact(F.array(*flags, F.when(none, "NO_CORE_CHANNELS"), F.when(late, "LATE_ARRIVAL")))


def channel_quality(channel: str, value: Column) -> Column:
    """valid, missing, zero_substituted, invalid or out_of_range."""
    if channel == "pressure":
        return F.when(value.isNull(), "missing").when(value < 1, "zero_substituted").otherwise("valid")
    if channel == "humidity":
        return F.when(value.isNull(), "missing").when(value < 0, "invalid").when(value > 100, "out_of_range").otherwise("valid")
    return F.when(value.isNull(), "missing").otherwise("valid")


def channel_value(channel: str, value: Column) -> Column:
    """The value, or null where its quality forbids use."""
    if channel == "pressure":
        return F.when(value >= 1, value)
    if channel == "humidity":
        return F.when(value >= 0, value)
    return value


def freshness(has_value: Column, age_s: Column, cadence_s: Column | float) -> Column:
    cadence = cadence_s if isinstance(cadence_s, Column) else F.lit(cadence_s)
    return (
        F.when(~has_value, "MISSING")
        .when(age_s.isNull() | (age_s < 0), "UNKNOWN")
        .when(age_s <= cadence, "LIVE")
        .otherwise("STALE")
    )


def from_future(observed_at: Column, received_at: Column) -> Column:
    return observed_at - received_at > F.expr(f"INTERVAL {FUTURE_MINUTES} MINUTES")


def plausible(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)


def selected_pressure(msl: Column, surface: Column) -> tuple[Column, Column]:
    """Sea-level pressure before surface pressure (0 counts as absent), and which it is."""
    sea, ground = F.nullif(msl, F.lit(0.0)), F.nullif(surface, F.lit(0.0))
    kind = F.when(sea.isNotNull(), "MSL").when(ground.isNotNull(), "SURFACE")
    return F.coalesce(sea, ground), kind


def severity_label(severity: Column) -> Column:
    return F.when(severity >= 0.75, "HIGH").when(severity >= 0.45, "WARNING").when(severity > 0, "LOW").otherwise("NONE")


def incident_severity(label: Column) -> Column:
    return F.when(label == "HIGH", "CRITICAL").when(label.isin("LOW", "NONE"), "INFO").otherwise("WARNING")


def valid_coordinates(lat: Column, lon: Column) -> Column:
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return ok & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def reject_cause(temperature: Column, humidity: Column, pressure: Column) -> Column:
    """The first cause for which a dataset row is unfit: null, then T, RH, P out of range."""
    missing = temperature.isNull() | humidity.isNull() | pressure.isNull()
    return (
        F.when(missing, "null")
        .when(~temperature.between(-50, 60), "temperature")
        .when(~humidity.between(0, 100), "humidity")
        .when(~pressure.between(300, 1100), "pressure")
    )


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by ``order``: a partial aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return picked.select(*keys, *[F.col("__last").getField(c).alias(c) for c in rest])


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` to append so that a repeated append changes nothing."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
