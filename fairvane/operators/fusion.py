"""Evidence fusion, root cause and verdicts as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FUSION_ACUTE, FUSION_THRESHOLD, FUSION_WEIGHTS, GALE_KMH, STORM_KMH
from ..functions.physics import clip

LAYERS = tuple(FUSION_WEIGHTS)


def physics_rule(t: Column, h: Column, p: Column, wind: Column, t_range=(-45, 50), p_range=(920, 1065)) -> Column:
    """The first physical rule that a reading breaks."""
    return (
        F.when((h < 0) | (h > 100), "RH_BOUNDS")
        .when(~t.between(*t_range), "T_BOUNDS")
        .when(~p.between(*p_range), "P_BOUNDS")
        .when(wind >= STORM_KMH, "STORM")
        .when(wind >= GALE_KMH, "GALE")
        .otherwise("OK")
    )


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for x in parts[1:]:
        out = out + x
    return out


def ensemble(score: dict[str, Column], available: dict[str, Column]) -> Column:
    """Weighted mean over the available layers, 0 without any; weights are added up as decimals, so that scores at the threshold reach it."""
    exact = {n: F.lit(Decimal(str(w))) for n, w in FUSION_WEIGHTS.items()}
    weight = _sum([F.when(available[n], w).otherwise(F.lit(Decimal(0))) for n, w in exact.items()]).cast("double")
    total = _sum([F.when(available[n], w * score[n]).otherwise(0.0) for n, w in FUSION_WEIGHTS.items()])
    return F.when(weight > 0, total / weight).otherwise(0.0)


def sufficiency(coverage: dict[str, Column], available: dict[str, Column]) -> Column:
    parts = [F.when(available[n], w * coverage[n]).otherwise(0.0) for n, w in FUSION_WEIGHTS.items()]
    return _sum(parts) / sum(FUSION_WEIGHTS.values())


def fused(
    score: dict[str, Column],
    available: dict[str, Column],
    coverage: dict[str, Column],
    veto: Column,
    neighbours: Column,
    history: Column,
    attribution: Column,
    counterfactual: Column,
) -> dict[str, Column]:
    """status, is_anomaly, severity and confidence from the layers' evidence.

    Drift is sensor-health context: it can raise a warning but no acute anomaly.
    """
    ens = ensemble(score, available)
    suff = sufficiency(coverage, available)
    present = {n: F.when(available[n], score[n]) for n in LAYERS}
    peak = F.coalesce(F.greatest(*present.values()), F.lit(0.0))
    n_available = _sum([available[n].cast("int") for n in LAYERS])
    acute = {n: available[n] & (score[n] >= FUSION_ACUTE[n]) for n in LAYERS}
    hit = (n_available >= 2) & (ens >= FUSION_THRESHOLD)
    for n in LAYERS:
        hit = hit | acute[n]
    severity = clip(0.6 * peak + 0.4 * ens, 0.0, 1.0)
    agrees = available["spatial"] & (score["spatial"] < 0.30)
    disagrees = available["spatial"] & (score["spatial"] >= 0.45)
    drifting = available["drift"] & (score["drift"] >= 0.75)
    isolated = F.coalesce(attribution == "ISOLATED_SENSOR_ANOMALY", F.lit(False))
    supported = F.coalesce((counterfactual == "SUPPORTED") | (attribution == "REGIONAL_EVENT"), F.lit(False))
    persistent = F.when(
        drifting,
        F.when(disagrees | isolated, "CORROBORATED_BY_SPATIAL").when(agrees, "REGIONALLY_EXPLAINED").otherwise("UNCORROBORATED"),
    )
    conflict = (agrees & (acute["physics"] | acute["temporal"] | acute["multivariate"])) | (acute["spatial"] & supported)
    support = F.array_compact(F.array(*[F.when(available[n] & (score[n] > 0.15), score[n]) for n in LAYERS]))
    k = F.size(support)
    mean = F.aggregate(support, F.lit(0.0), lambda a, x: a + x) / F.greatest(k, F.lit(1))
    square = F.aggregate(support, F.lit(0.0), lambda a, x: a + x * x) / F.greatest(k, F.lit(1))
    spread = F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))
    even = F.when(k >= 2, clip(1 - spread / F.greatest(F.lit(0.1), mean), 0.5, 1.0)).otherwise(1.0)
    agreement = even * F.when(conflict, 0.75).otherwise(1.0)
    cap = F.when(k <= 1, 0.65).when(k == 2, 0.80).otherwise(0.95)
    raw = F.least(cap, peak)
    raw = raw * F.when((score["spatial"] > 0.1) & (neighbours < 3), 0.85).otherwise(1.0)
    raw = raw * F.when((score["temporal"] > 0.1) & (history < 5), 0.90).otherwise(1.0)
    sure = clip(raw * (0.65 + 0.35 * suff) * agreement, 0.10, 0.97)
    strong = ((severity >= 0.60) | (peak >= 0.75)) & (sure >= 0.30)
    degraded = persistent.isin("CORROBORATED_BY_SPATIAL", "UNCORROBORATED") & persistent.isNotNull()
    mild = (severity >= 0.35) | (peak >= 0.60)
    calm = (
        F.when(degraded, F.when(persistent == "CORROBORATED_BY_SPATIAL", 0.70).otherwise(0.50)).when(mild, 0.70).otherwise(0.90)
    )
    calm_confidence = clip(calm * (0.30 + 0.70 * suff), 0.10, 0.95)
    status = (
        F.when(veto, "ANOMALY")
        .when(hit, F.when(strong, "ANOMALY").otherwise("WARNING"))
        .otherwise(F.when(degraded | mild, "WARNING").otherwise("NORMAL"))
    )
    return {
        "status": status,
        "is_anomaly": F.when(veto, True).when(hit, strong | (peak >= 0.85)).otherwise(False),
        "severity": F.when(veto, 1.0).when(hit, severity).when(degraded, F.greatest(severity, F.lit(0.45))).otherwise(severity),
        "confidence": F.when(veto, 0.95).when(hit, sure).otherwise(calm_confidence),
        "persistent": persistent,
        "ensemble": ens,
        "sufficiency": suff,
        "conflict": conflict,
    }


def root_cause(
    is_anomaly: Column,
    veto: Column,
    persistent: Column,
    score: dict[str, Column],
    frozen: Column,
    abrupt: Column,
    outlier: Column,
    cusum: Column,
    neighbours: Column,
    clean_neighbours: Column,
    drift_samples: Column,
    regional: Column,
) -> Column:
    """The first diagnosis whose conditions hold; flags stand for the layers' reasons."""
    s = score
    regional = F.coalesce(regional, F.lit(False))
    explained = F.coalesce(persistent == "REGIONALLY_EXPLAINED", F.lit(False))
    degraded = F.coalesce(persistent.isin("CORROBORATED_BY_SPATIAL", "UNCORROBORATED"), F.lit(False))
    active = _sum([(s[n] > 0.20).cast("int") for n in (*LAYERS, "drift")])
    peak = F.greatest(*[s[n] for n in (*LAYERS, "drift")])
    snap_back = (s["temporal"] > 0.60) & (s["spatial"] < 0.30) & (s["drift"] >= 0.40) & (neighbours >= 2) & (drift_samples >= 12)
    weather = (s["temporal"] > 0.60) & (neighbours >= 2) & ((s["spatial"] < 0.30) | regional)
    return (
        F.when(~is_anomaly & degraded, "CALIBRATION_DRIFT")
        .when(~is_anomaly, "NORMAL")
        .when(veto, "SINGLE_CHANNEL_FAULT")
        .when((active <= 1) & (peak < 0.60), "INSUFFICIENT_EVIDENCE")
        .when(frozen, "FROZEN_SENSOR")
        .when(snap_back, "CALIBRATION_DRIFT")
        .when(weather & (clean_neighbours >= 4), "GENUINE_EXTREME_WEATHER")
        .when(weather, "POSSIBLE_WEATHER_CHANGE")
        .when(abrupt, "SENSOR_SPIKE")
        .when(cusum & ~explained, "CALIBRATION_DRIFT")
        .when(s["spatial"] >= 0.65, "SINGLE_CHANNEL_FAULT")
        .when(outlier, "NOISE_BURST")
        .when(s["multivariate"] >= 0.65, F.when(s["temporal"] > 0.20, "NOISE_BURST").otherwise("INSUFFICIENT_EVIDENCE"))
        .otherwise("INSUFFICIENT_EVIDENCE")
    )


HARDWARE_CAUSES = ("SINGLE_CHANNEL_FAULT", "FROZEN_SENSOR", "CALIBRATION_DRIFT", "SENSOR_SPIKE", "NOISE_BURST")


def guarded_cause(cause: Column, source: Column) -> Column:
    """A model reference has no hardware that could fail."""
    return F.when((source == "NWP_MODEL_REFERENCE") & cause.isin(*HARDWARE_CAUSES), "MODEL_REFERENCE_INCONSISTENCY").otherwise(cause)


def layer_card(layer: str, score: Column, available: Column) -> Column:
    """Display status of one layer."""
    high, mid = {"temporal": (0.70, 0.40), "multivariate": (0.75, 0.50), "spatial": (0.70, 0.45), "drift": (0.70, 0.40)}[layer]
    return F.when(~available, "INSUFFICIENT").when(score >= high, "ANOMALY").when(score >= mid, "WARNING").otherwise("NORMAL")


def verdict_axes(status: Column, cause: Column) -> dict[str, Column]:
    """Interpretation, shown status, category and action of a diagnosed verdict."""
    weather = cause.isin("GENUINE_EXTREME_WEATHER", "POSSIBLE_WEATHER_CHANGE")
    fault = cause.isin(*HARDWARE_CAUSES)
    interpretation = (
        F.when(status == "NORMAL", "nominal").when(weather, "weather_event").when(fault, "sensor_fault").otherwise("uncertain")
    )
    action = (
        F.when(status == "NORMAL", "NONE")
        .when(weather, "MONITOR")
        .when(cause.isin("FROZEN_SENSOR", "SINGLE_CHANNEL_FAULT"), "INSPECT")
        .when(cause == "CALIBRATION_DRIFT", "RECALIBRATE")
        .otherwise("VERIFY")
    )
    shown = F.when(interpretation == "sensor_fault", F.when(status == "ANOMALY", "fault").otherwise("suspect")).otherwise(interpretation)
    return {"interpretation": interpretation, "overall_status": shown, "action": action}
