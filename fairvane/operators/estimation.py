"""Which channels a verdict concerns, and whether and how their values are replaced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Diagnoses for which an estimate may stand in for the reading.
ESTIMABLE = ("SENSOR_SPIKE", "FROZEN_SENSOR", "SINGLE_CHANNEL_FAULT", "NOISE_BURST")
_WORDS = {"temperature": "temp", "pressure": "press", "humidity": "humid"}


def affected_channels(
    temporal: dict[str, Column], physics: Column, reason: Column, spatial: Column, multivariate: Column, veto: Column,
    valid: dict[str, Column],
) -> Column:
    """Channels with a temporal score over 0.5 or named by the physics reason.

    Where none is, and a spatial or multivariate score or a veto speaks, the first valid channel.
    """
    told = F.lower(F.coalesce(reason, F.lit("")))
    blamed = [
        F.when((F.coalesce(temporal[n], F.lit(0.0)) > 0.5) | ((physics > 0.5) & told.contains(word)), n) for n, word in _WORDS.items()
    ]
    named = F.array_compact(F.array(*blamed))
    first = F.coalesce(*[F.when(valid[n], n) for n in _WORDS])
    other = F.when((spatial > 0.5) | (multivariate > 0.5) | veto, F.array_compact(F.array(first)))
    return F.when(F.size(named) > 0, named).otherwise(F.coalesce(other, F.array().cast("array<string>")))


def estimation_decision(anomalous: Column, fault: Column, tier: Column, counterfactual: Column, attribution: Column, affected: Column) -> Column:
    """Struct of justified, refusal (null if justified) and channel, the first affected one."""
    supported = (F.coalesce(counterfactual, F.lit("")) == "SUPPORTED") | (F.coalesce(attribution, F.lit("")) == "REGIONAL_EVENT")
    refusal = (
        F.when(~anomalous, "NO_ANOMALY")
        .when(~fault.isin(*ESTIMABLE), "FAULT_NOT_ELIGIBLE")
        .when(~tier.isin("MEDIUM", "HIGH"), "CONFIDENCE_TOO_LOW")
        .when(supported, "REGION_SUPPORTS_READING")
        .when(F.size(affected) == 0, "NO_CHANNEL")
    )
    return F.struct(
        refusal.isNull().alias("justified"), refusal.alias("refusal"), F.when(refusal.isNull(), F.get(affected, F.lit(0))).alias("channel")
    )


def estimated(raw: Column, justified: Column, consensus: Column, physical: Column, model: Column, last: Column) -> Column:
    """The first of consensus, physical inversion, model and last value, to two places; the reading itself if not justified."""
    return F.when(justified, F.coalesce(F.round(F.coalesce(consensus, physical, model, last), 2), raw)).otherwise(raw)


def layers_agreeing(scores: Column, bucket: Column) -> Column:
    """Of a map of layer scores, those that are at 0.5 or more just if the bucket is an abnormal one."""
    abnormal = bucket.isin("LIKELY_SENSOR_ANOMALY", "DATA_QUALITY_VIOLATION", "POSSIBLE_WEATHER_EVENT")
    return F.size(F.filter(F.map_values(scores), lambda v: (v >= 0.5) == abnormal))
