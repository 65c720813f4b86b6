"""What a reader is told of the layers' evidence: states, display status and summary sentence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The layers, their names in sentences, and the labels of display statuses.
LAYER_NAMES = {"L1": "Physics", "L2": "Temporal", "L3": "Multivariate", "L4": "Spatial", "L5": "Sensor health"}
DISPLAY_LABELS = {"NO_ANOMALY_CONFIRMED": "NO ANOMALY CONFIRMED", "INSUFFICIENT_EVIDENCE": "INSUFFICIENT EVIDENCE"}
#: How a summary ends, by interpretation.
ENDINGS = {
    "likely_sensor_fault": "Therefore likely a sensor fault.",
    "likely_weather_event": "Neighbouring stations show the same change — therefore likely a genuine weather event, not a sensor fault.",
    "communication_issue": "Therefore likely a communication issue.",
    "uncertain": "Evidence is not yet conclusive; monitoring.",
}
ASSESSED = ("PASS", "WARNING", "ANOMALY")


def layer_state(status: Column, available: Column) -> Column:
    """The state of a layer from its card's status and the report of what was available.

    No card, or a status that is not known, is UNAVAILABLE.  Where the two disagree the
    more careful one holds: a layer reported as not available is INSUFFICIENT.
    """
    said = F.upper(F.coalesce(status, F.lit("UNAVAILABLE")))
    absent = ~F.coalesce(available, F.lit(True))
    return (
        F.when(said.isin("NOT_APPLICABLE", "UNAVAILABLE"), said)
        .when(said.isin("INSUFFICIENT_DATA", "LIMITED") | absent, "INSUFFICIENT")
        .when(said == "VETO", "ANOMALY")
        .when(said.isin(*ASSESSED), said)
        .otherwise("UNAVAILABLE")
    )


def display_status(states: dict[str, Column], backend: Column, diagnosis: Column, in_situ: Column) -> Column:
    """(status, label, detail) of a reading: NORMAL only if every layer assessed an in-situ reading."""
    done = F.array_compact(F.array(*[F.when(s.isin(*ASSESSED), F.lit(n)) for n, s in states.items()]))
    left = F.array_compact(F.array(*[F.when(~s.isin(*ASSESSED), F.lit(n)) for n, s in states.items()]))
    said = F.upper(F.coalesce(backend, F.lit("")))
    unknown = (F.size(done) == 0) | F.coalesce(diagnosis == "INSUFFICIENT_EVIDENCE", F.lit(False))
    status = (
        F.when(said.isin("OFFLINE", "ANOMALY", "WARNING"), said)
        .when(unknown, "INSUFFICIENT_EVIDENCE")
        .when(~F.coalesce(in_situ, F.lit(False)) | (F.size(left) > 0), "NO_ANOMALY_CONFIRMED")
        .otherwise("NORMAL")
    )
    label = status
    for name, text in DISPLAY_LABELS.items():
        label = F.when(status == name, text).otherwise(label)
    by = F.when(F.size(done) > 0, F.concat(F.lit(" ("), F.array_join(done, ", "), F.lit(")"))).otherwise("")
    some = F.concat(
        F.lit("Assessed by "), F.size(done).cast("string"), F.lit(f" of {len(states)} layers"), by,
        F.lit(". Not assessed: "), F.array_join(left, ", "), F.lit("."),
    )
    detail = F.when(F.size(left) == 0, f"All {len(states)} layers assessed this observation.").otherwise(some)
    return F.struct(status.alias("status"), label.alias("label"), detail.alias("detail"))


def summary_sentence(
    status: Column, confidence: Column, interpretation: Column, cards: dict[str, tuple[Column, Column, Column]]
) -> Column:
    """One sentence for a detection; ``cards`` holds (triggered, status, reason) by layer.

    A nominal reading is said to be so only for the layers that ran.
    """
    head = F.concat(F.upper(status), F.lit(" — "), F.bround(confidence * 100).cast("long").cast("string"), F.lit("% confidence"))
    ran = {k: F.coalesce(s.isin(*ASSESSED, "VETO"), F.lit(False)) for k, (_, s, _) in cards.items()}
    pending = F.array_compact(F.array(*[F.when(~ran[k], F.lit(LAYER_NAMES.get(k, k))) for k in cards]))
    names = F.array_join(pending, ", ")
    others = F.array_compact(
        F.array(*[F.when(~ran[k] & ~F.coalesce(s == "INSUFFICIENT_DATA", F.lit(False)), F.lit(k)) for k, (_, s, _) in cards.items()])
    )
    why = F.when(
        F.size(others) == 0, F.concat(F.lit("intelligence history warming up ("), names, F.lit(" not yet evaluated)."))
    ).otherwise(F.concat(F.lit("not evaluated: "), names, F.lit(".")))
    partly = F.concat(
        head, F.lit(". "), (len(cards) - F.size(pending)).cast("string"),
        F.lit(f" of {len(cards)} layers assessed, all within nominal envelopes; "), why,
    )
    calm = F.when(F.size(pending) == 0, F.concat(head, F.lit(". All five layers within nominal envelopes."))).otherwise(partly)
    told = F.array_compact(
        F.array(*[F.when(hit, F.concat(F.lit(f"{k}: "), F.coalesce(reason, F.lit("")))) for k, (hit, _, reason) in cards.items()])
    )
    body = F.when(F.size(told) > 0, F.array_join(told, "; ")).otherwise("No individual layer crossed its threshold")
    ending = F.lit("")
    for name, text in ENDINGS.items():
        ending = F.when(interpretation == name, text).otherwise(ending)
    loud = F.trim(F.concat(head, F.lit(". "), body, F.lit(". "), ending))
    return F.when((status == "nominal") & (interpretation == "nominal"), calm).otherwise(loud)
