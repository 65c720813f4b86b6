"""A diagnosis in words: what was observed, on which evidence, and how sure the wording may sound."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording that clients compare with.
CERTAINTY = {"HIGH": "Likely", "MEDIUM": "Possible", "LOW": "Potential (low confidence)"}
NO_CERTAINTY = "Uncertain"
ADVICE = {"HIGH": "", "MEDIUM": "If confirmed: ", "LOW": "Suggested: "}
NO_ADVICE = "If it continues: "
SENTENCES = {
    "NORMAL": "All sensors within normal operating limits ({normal}). Sensor health: {health}%.",
    "GENUINE_EXTREME_WEATHER": "{station}: Real meteorological event likely. Observed: {observed}. Evidence: {evidence}. "
    "Nearby stations show similar conditions — not a sensor issue. Sensor health: {health}%.",
    "POSSIBLE_WEATHER_CHANGE": "{station}: Rapid change recorded. Observed: {observed}. Evidence: {evidence}. "
    "Insufficient spatial data to determine if this is regional weather or a station-level anomaly. "
    "Monitor nearby stations for comparison.",
    "FROZEN_SENSOR": "{certainty} frozen sensor at {station}. Observed: {observed}. Evidence: {evidence}. "
    "Sensor health: {health}%. {advice}Inspect sensor for physical obstruction or ADC lockup.",
    "SENSOR_SPIKE": "{certainty} sensor transient at {station}. Observed: {observed}. Evidence: {evidence}.{alternative} "
    "Sensor health: {health}%. {advice}Check sensor cable and power supply. Confirm with next observation.",
    "CALIBRATION_DRIFT": "{certainty} calibration drift at {station}. Observed: {observed}. Evidence: {evidence}.{extrapolation} "
    "Sensor health: {health}%. {advice}Compare with secondary reference sensor.",
    "SINGLE_CHANNEL_FAULT": "{certainty} station-level discrepancy at {station}. Observed: {observed}. Evidence: {evidence}. "
    "Station diverges from neighbouring measurements. Sensor health: {health}%. "
    "{advice}Inspect and compare with nearby stations.",
    "NOISE_BURST": "{certainty} measurement noise at {station}. Observed: {observed}. Evidence: {evidence}. "
    "This may self-resolve. {advice}Monitor next reading.",
    "INSUFFICIENT_EVIDENCE": "Anomaly threshold reached at {station}, but evidence is limited. Observed: {observed}. "
    "Available signal: {signal}. Sensor health: {health}%. Monitor closely over the next few observations.",
    "COMMUNICATION_OUTAGE": "Data communication disruption at {station}. No valid sensor readings received.",
    "MODEL_REFERENCE_INCONSISTENCY": "Anomalous pattern detected at {station} in the NWP model reference value "
    "(no AWS in-situ sensor is connected for this station). Observed: {observed}. Evidence: {evidence}. "
    "This reflects model-output behavior, not physical sensor health, and should not be treated as a hardware fault.",
}
OTHER_SENTENCE = "Anomaly at {station}. Observed: {observed}. Evidence: {evidence}. Sensor health: {health}%."
EXTRAPOLATION = (
    " Rough drift-rate extrapolation: tolerance could be exceeded in about {days} days (indicative only, not a failure prediction)."
)
EXTRAPOLATION_DAYS = 30
#: Of each channel: how it reads in a list of sound channels, and among observed values.
CHANNELS = {"temperature": ("temperature ", "T=", "°C"), "pressure": ("pressure ", "P=", " hPa"), "humidity": ("humidity ", "RH=", "%")}
NO_CHANNELS, NO_VALUES, NO_SIGNAL = "available channels", "some channels have missing data", "no specific pattern identified"
SHOWN_REASONS = 3


def _chosen(texts: Mapping[str, str], by: Column, otherwise: str) -> Column:
    table = F.create_map(*[F.lit(x) for item in texts.items() for x in item])
    return F.coalesce(F.try_element_at(table, by), F.lit(otherwise))


def _filled(template: str, parts: Mapping[str, Column]) -> Column:
    """The template with its named places filled; text and names take turns."""
    pieces = enumerate(re.split(r"\{(\w+)\}", template))
    return F.concat(*[parts[piece] if i % 2 else F.lit(piece) for i, piece in pieces])


def _listed(values: list[Column], otherwise: str) -> Column:
    kept = F.array_compact(F.array(*values))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise(otherwise)


def explanation(
    fault: Column,
    confidence: Column,
    station: Column,
    values: Mapping[str, Column],
    usable: Mapping[str, Column],
    reasons: Column,
    signal: Column,
    health: Column,
    days_left: Column,
    alternatives: Column,
) -> Column:
    """The explanation of one reading's diagnosis.

    ``values`` and ``usable`` are by channel (``CHANNELS``): a channel that is not usable is left out of
    what was observed, though a sound station lists it.  ``reasons`` and ``alternatives`` are arrays of
    text, of which three and one are shown; without a reason the ``signal`` stands for them.  Numbers are
    rounded from their binary value, half to even.  A null or unknown fault gives the general sentence, a
    null confidence the unsure wording, a null or NaN value is missing, and a null station or health reads
    ``unknown``.  A null flag is false, null arrays and signals are empty.
    """

    def number(x: Column, form: str) -> Column:
        return F.call_function("format_number", x.cast("double"), F.lit(form))

    sound, seen = [], []
    for name, (label, short, unit) in CHANNELS.items():
        there = values[name].isNotNull() & ~F.isnan(values[name].cast("double"))
        shown = F.concat(number(values[name], "0.0"), F.lit(unit))
        sound.append(F.when(there, F.concat(F.lit(label), shown)))
        seen.append(F.when(there & F.coalesce(usable[name], F.lit(False)), F.concat(F.lit(short), shown)))
    told = F.array_compact(F.coalesce(reasons, F.array().cast("array<string>")))
    evidence = F.when(F.size(told) > 0, F.array_join(F.slice(told, 1, SHOWN_REASONS), "; ")).otherwise(F.coalesce(signal, F.lit("")))
    first = F.get(alternatives, F.lit(0))
    soon = F.coalesce(days_left < EXTRAPOLATION_DAYS, F.lit(False))
    parts = {
        "station": F.coalesce(station.cast("string"), F.lit("unknown")),
        "health": F.coalesce(number(health, "0"), F.lit("unknown")),
        "normal": _listed(sound, NO_CHANNELS),
        "observed": _listed(seen, NO_VALUES),
        "evidence": evidence,
        "signal": F.when(evidence == "", NO_SIGNAL).otherwise(evidence),
        "certainty": _chosen(CERTAINTY, confidence, NO_CERTAINTY),
        "advice": _chosen(ADVICE, confidence, NO_ADVICE),
        "alternative": F.coalesce(F.concat(F.lit(" Alternative: "), first, F.lit(".")), F.lit("")),
        "extrapolation": F.when(soon, _filled(EXTRAPOLATION, {"days": number(days_left, "0")})).otherwise(""),
    }
    text = F.when(F.lit(False), "")
    for name, template in SENTENCES.items():
        text = text.when(fault == name, _filled(template, parts))
    return text.otherwise(_filled(OTHER_SENTENCE, parts))
