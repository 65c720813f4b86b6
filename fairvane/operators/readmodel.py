"""Read models: narratives, gated actions, correlation with incidents, compact projections."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Texts and limits that clients compare with.
STABLE = "Stable atmospheric conditions within seasonal expectations"
INSUFFICIENT = "Insufficient observational data to evaluate current meteorological conditions."
WATCH_ACTION = "Monitor. No immediate action required."
OBSERVE_ACTION = "Observe the next several readings before taking action."
LOW_ACTION = "Monitor closely. Compare with neighboring stations. No hardware action yet."
MEDIUM_ACTIONS = {
    "SENSOR_SPIKE": "Verify sensor data against neighbours. If repeated, schedule inspection.",
    "FROZEN_SENSOR": "Attempt remote power-cycle if supported. If unresponsive, schedule field visit.",
    "CALIBRATION_DRIFT": "Compare against secondary reference. If confirmed, schedule recalibration.",
    "NOISE_BURST": "Monitor. Check antenna and cable shielding if recurring.",
    "SINGLE_CHANNEL_FAULT": "Inspect and cross-check against nearby stations.",
    "GENUINE_EXTREME_WEATHER": "No hardware action. Monitor for storm damage.",
    "POSSIBLE_WEATHER_CHANGE": "Compare with nearby stations before acting.",
}
HIGH_ACTIONS = {
    "SENSOR_SPIKE": "Check cable shielding and power supply. Replace if recurring.",
    "FROZEN_SENSOR": "Power-cycle the sensor. If still frozen, replace transducer.",
    "CALIBRATION_DRIFT": "Recalibrate against secondary reference. Plan sensor replacement if drift is severe.",
    "NOISE_BURST": "Inspect analog wiring and RF interference sources.",
    "SINGLE_CHANNEL_FAULT": "Channel appears disconnected or reporting impossible values. Inspect sensor module.",
    "GENUINE_EXTREME_WEATHER": "No action — real severe weather. Inspect for storm damage post-event.",
    "POSSIBLE_WEATHER_CHANGE": "Monitor. Compare with regional NWP data.",
}
CLOSED = ("RESOLVED", "DISMISSED")
SPATIAL_SPREAD = {"temperature": 1.0, "humidity": 3.0, "pressure": 0.8}
REGIONAL_CHANGE = {"temperature": 2.0, "humidity": 8.0, "pressure": 1.5}


def weather_narrative(temperature: Column, pressure: Column, humidity: Column, abrupt: Column, neighbours: Column, deviation: Column) -> Column:
    """A struct of summary, phenomenon and confidence, from validated readings only.

    ``abrupt`` is whether the temperature jumped, ``deviation`` that from the consensus of
    ``neighbours`` stations.
    """
    heat, low = F.coalesce(temperature > 35, F.lit(False)), F.coalesce(pressure < 1000, F.lit(False))
    damp, jump = F.coalesce(humidity >= 90, F.lit(False)), F.coalesce(abrupt, F.lit(False))
    parts = F.array_compact(
        F.array(
            F.when(heat, "Elevated heat conditions").when(temperature < 5, "Cold surface temperatures"),
            F.when(low, "Low-pressure system influence").when(pressure > 1025, "High-pressure anticyclonic conditions"),
            F.when(damp, "Near-saturated atmospheric moisture").when(humidity <= 20, "Arid low-humidity regime"),
            F.when(jump, "Abrupt thermal transition"),
            F.when(
                (neighbours >= 2) & deviation.isNotNull(),
                F.when(F.abs(deviation) > 5, "Localized thermal discrepancy relative to regional mesh").otherwise(
                    "Consistent with regional temperature field"
                ),
            ),
        )
    )
    valid = sum((x.isNotNull().cast("int") for x in (temperature, pressure, humidity)), F.lit(0))
    text = F.concat(F.when(F.size(parts) > 0, F.array_join(parts, ". ")).otherwise(STABLE), F.lit("."))
    phenomenon = (
        F.when(jump, "Localized frontal boundary passage or microclimate transition")
        .when(low, "Cyclonic or depression trough system")
        .when(heat, "Diurnal heat peak or local thermal plume")
        .when(damp, "Surface saturation, mist, or active precipitation")
        .otherwise("Nominal atmospheric regime")
    )
    confidence = F.when((valid >= 2) & (neighbours >= 2), "HIGH").otherwise("MEDIUM")
    return F.struct(
        F.when(valid == 0, INSUFFICIENT).otherwise(text).alias("summary"),
        F.when(valid > 0, phenomenon).alias("phenomenon"),
        F.when(valid > 0, confidence).alias("confidence"),
    )


def operator_action(fault: Column, confidence: Column, days_left: Column) -> Column:
    """What an operator may do; hardware is never replaced on low or medium confidence."""

    def chosen(actions: dict[str, str], otherwise: str) -> Column:
        known = F.create_map(*[F.lit(x) for item in actions.items() for x in item])
        return F.coalesce(F.try_element_at(known, fault), F.lit(otherwise))

    note = F.when(
        days_left < 7,
        F.concat(
            F.lit(" Note: rough drift-rate extrapolation suggests the tolerance could be exceeded in about "),
            F.bround(days_left, 0).cast("int").cast("string"),
            F.lit(" days (indicative only, not a failure prediction)."),
        ),
    )
    acting = F.when(confidence == "MEDIUM", chosen(MEDIUM_ACTIONS, "Investigate and monitor.")).otherwise(
        chosen(HIGH_ACTIONS, "Inspect station hardware.")
    )
    return (
        F.when(fault.isin("NORMAL", "INSUFFICIENT_EVIDENCE"), WATCH_ACTION)
        .when(confidence == "INSUFFICIENT_DATA", OBSERVE_ACTION)
        .when(confidence == "LOW", LOW_ACTION)
        .otherwise(F.concat(acting, F.coalesce(note, F.lit(""))))
    )


def with_open_incident(rows: DataFrame, incidents: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with the newest open incident_id of their keys, or null.

    ``incidents`` has incident_id, status, the keys and the order's columns.
    """
    live = incidents.where(~F.col("status").isin(*CLOSED))
    newest = live.groupBy(*keys).agg(F.max_by("incident_id", F.struct(*order)).alias("incident_id"))
    return rows.join(newest, keys, "left")


def recorded_events(notes: DataFrame, incidents: DataFrame) -> DataFrame:
    """System notes (incident_id, event, note) of incidents that are still open; others are not recorded."""
    live = incidents.where(~F.col("status").isin(*CLOSED)).select("incident_id")
    return notes.join(live, "incident_id", "left_semi")


def escalation_preview(incidents: DataFrame) -> DataFrame:
    """What an escalation would send, read only."""
    unit = F.coalesce("unit", F.lit(""))

    def with_unit(text: Column) -> Column:
        return F.trim(F.concat_ws(" ", text, unit))

    place = F.concat_ws(", ", F.nullif("town", F.lit("")), F.nullif("country", F.lit("")))
    return incidents.select(
        "incident_id",
        F.lit("Meteorological Operations Team").alias("recipient"),
        F.format_string("%s AWS anomaly — %s (%s)", "severity", F.col("incident_id").cast("string"), F.col("station_id").cast("string")).alias("subject"),
        F.when(place == "", "Unknown location").otherwise(place).alias("location"),
        F.coalesce(F.when(F.col("observed").isNotNull(), with_unit(F.col("observed").cast("string"))), F.lit("N/A")).alias("observed"),
        F.when(
            F.col("expected_min").isNotNull() & F.col("expected_max").isNotNull(),
            with_unit(F.concat_ws("-", F.col("expected_min").cast("string"), F.col("expected_max").cast("string"))),
        )
        .otherwise("N/A")
        .alias("expected"),
        F.bround(F.coalesce("confidence", F.lit(0.0)) * 100, 0).cast("int").alias("confidence_pct"),
        F.lit(True).alias("is_preview_only"),
    )


def compact_event(detections: DataFrame, columns: list[str], diagnosis: str = "diagnosis") -> DataFrame:
    """The slice of a detection that is pushed: ``columns``, and root cause and label out of the diagnosis."""
    return detections.select(*columns, F.col(f"{diagnosis}.root_cause").alias("root_cause"), F.col(f"{diagnosis}.label").alias("rca_label"))


def shown_neighbours(status: Column, neighbours: Column) -> Column:
    """All neighbours of a row that is not nominal, the first three of one that is."""
    return F.when(status == "nominal", F.slice(neighbours, 1, 3)).otherwise(neighbours)


def spatial_verdict(parameter: str, own_change: Column, changes: Column) -> Column:
    """Whether a station's change is shared by its neighbours (an array of changes, nulls left out)."""
    ordered = F.sort_array(F.array_compact(changes))
    size = F.size(ordered)
    median = F.get(ordered, F.floor(size / 2).cast("int"))
    return spatial_verdict_of(parameter, own_change, size, F.get(ordered, F.lit(0)), median, F.get(ordered, size - 1))


def spatial_verdict_of(parameter: str, own_change: Column, size: Column, low: Column, median: Column, high: Column) -> Column:
    """``spatial_verdict`` from the number, least, upper median and greatest of the neighbours' changes."""
    spread = F.greatest(F.lit(SPATIAL_SPREAD[parameter]), (high - low) / 2)
    shared = F.when(F.abs(median) >= REGIONAL_CHANGE[parameter], "regional_event").otherwise("consistent")
    enough = (size >= 2) & own_change.isNotNull()
    return F.when(~enough, "insufficient_neighbours").when(F.abs(own_change - median) <= spread, shared).otherwise("isolated")


def ensemble_mean(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the layers that have a score, their weights made to add up to one; 0 without any.

    Weights are added up as decimals, so that the same layers always give the same sum.
    """
    exact = {n: F.lit(Decimal(str(w))) for n, w in weights.items()}
    total = sum((F.when(s.isNotNull(), exact[n]).otherwise(F.lit(Decimal(0))) for n, s in scores.items()), F.lit(Decimal(0))).cast("double")
    summed = sum((F.coalesce(s * weights[n], F.lit(0.0)) for n, s in scores.items()), F.lit(0.0))
    return F.when(total > 0, summed / total).otherwise(0.0)


def isolated_failures(records: DataFrame, numbers: list[str]) -> DataFrame:
    """Numbers parsed from text, with ``state`` PROCESSING_ERROR (and the first bad column) where one is none.

    One bad record leaves the others as they are.
    """
    bad = [F.when(F.col(n).isNotNull() & F.col(n).try_cast("double").isNull(), n) for n in numbers]
    error = F.coalesce(*bad)
    return records.select(
        *[c for c in records.columns if c not in numbers],
        *[F.when(error.isNull(), F.col(n).try_cast("double")).alias(n) for n in numbers],
        F.when(error.isNull(), "PROCESSED").otherwise("PROCESSING_ERROR").alias("state"),
        error.alias("bad_column"),
    )


def last_against_group(df: DataFrame, key: str, value: str, order: list[str], floor: float) -> DataFrame:
    """Median, MAD and modified z of each group's last value against its whole history.

    Medians come from counts per distinct value; every group is reduced by partial sums.
    """

    def middle(counts: DataFrame, name: str, out: str) -> DataFrame:
        w = Window.partitionBy(key)
        running = F.sum("n").over(w.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
        marked = counts.withColumn("upto", running).withColumn("total", F.sum("n").over(w))
        low = F.min(F.when(F.col("upto") >= F.floor((F.col("total") + 1) / 2), F.col(name)))
        high = F.min(F.when(F.col("upto") >= F.floor(F.col("total") / 2) + 1, F.col(name)))
        return marked.groupBy(key).agg(((low + high) / 2).alias(out))

    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    median = middle(counts, "v", "median")
    apart = counts.join(median, key).groupBy(key, F.abs(F.col("v") - F.col("median")).alias("d")).agg(F.sum("n").alias("n"))
    last = known.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("last"))
    out = last.join(median, key).join(middle(apart, "d", "mad"), key)
    return out.withColumn("z", 0.6745 * F.abs(F.col("last") - F.col("median")) / F.greatest(F.col("mad"), F.lit(floor)))


def incident_snapshots(stations: DataFrame, alerts: DataFrame) -> DataFrame:
    """What an incident is made from: each station's latest alert, where it calls for one.

    ``stations`` has id, name, region, offline and freshness; ``alerts`` station_id, event_id,
    observed_at, status, severity_score and confidence.  Stations that are offline, without an
    alert or with another status than WARNING or ANOMALY give none.  A station whose values have
    no verifiable time is a STATIC_SNAPSHOT, never live.
    """
    rest = [c for c in alerts.columns if c != "station_id"]
    latest = alerts.groupBy("station_id").agg(F.max_by(F.struct(*rest), F.struct("observed_at", "event_id")).alias("alert"))
    static = F.coalesce(F.col("freshness"), F.lit("UNKNOWN")).isin("UNKNOWN", "MISSING")
    met = stations.join(latest, F.col("id") == F.col("station_id")).where("not offline and alert.status in ('WARNING', 'ANOMALY')")
    return met.select(
        "station_id",
        F.col("name").alias("station_name"),
        "region",
        F.col("alert.status").alias("status"),
        F.round("alert.severity_score", 3).alias("anomaly_score"),
        F.round("alert.confidence", 3).alias("confidence"),
        F.col("alert.observed_at").alias("observed_at"),
        F.when(static, "STATIC_SNAPSHOT").otherwise("LIVE_AWS").alias("source"),
    )


def recovery(observations: DataFrame, lookback_from: Column, per_station: int = 20) -> DataFrame:
    """After a restart: each station's last time since ``lookback_from`` (else null) and its last rows to replay."""
    newest = Window.partitionBy("station_id").orderBy(F.desc("observed_at"), F.desc("event_id"))
    rows = observations.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= per_station)
    last = F.max(F.when(F.col("observed_at") >= lookback_from, F.col("observed_at")))
    return rows.groupBy("station_id").agg(
        last.alias("last_observed"), F.count("*").alias("replayed"), F.min("observed_at").alias("replay_from")
    )


def network_recount(stations: DataFrame) -> DataFrame:
    """Counts of stations by status, staleness, watch, interpretation and kind of source, in one row."""
    status = [F.count_if(F.col("overall_status") == s).alias(s) for s in ("nominal", "suspect", "degraded", "anomaly")]
    return stations.agg(
        F.count("*").alias("live_stations"),
        *status,
        F.count_if(F.col("freshness") == "STALE").alias("stale"),
        F.count_if("watch").alias("watch"),
        F.count_if(F.col("interpretation") == "likely_weather_event").alias("weather_events"),
        F.count_if("simulated").alias("simulated"),
        F.count_if(~F.col("simulated")).alias("measured"),
    )
