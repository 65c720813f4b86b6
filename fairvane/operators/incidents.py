"""Incidents, work orders, alarms and events as folds and windows over ordered verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Allowed transitions of the two life cycles.
INCIDENT_EDGES = (
    ("NEW", "ACKNOWLEDGED"),
    ("NEW", "INVESTIGATING"),
    ("NEW", "DISMISSED"),
    ("ACKNOWLEDGED", "INVESTIGATING"),
    ("ACKNOWLEDGED", "DISMISSED"),
    ("INVESTIGATING", "ESCALATED"),
    ("INVESTIGATING", "RESOLVED"),
    ("INVESTIGATING", "DISMISSED"),
    ("ESCALATED", "RESOLVED"),
)
WORK_ORDER_EDGES = (("CREATED", "ASSIGNED"), ("ASSIGNED", "IN_PROGRESS"), ("IN_PROGRESS", "COMPLETED"))


def checked_transitions(steps: DataFrame, key: str, status: str, order: list[str], edges, first: str) -> DataFrame:
    """Each step with its predecessor and whether the life cycle allows it.

    Staying in a status is allowed and changes nothing.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before = F.coalesce(F.lag(status).over(w), F.lit(first))
    pair = F.concat_ws(">", before, F.col(status))
    ok = (before == F.col(status)) | pair.isin(*[f"{a}>{b}" for a, b in edges])
    return steps.withColumn("before", before).withColumn("allowed", ok)


def alarm_states(verdicts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Hysteresis: a lone undiagnosed warning shows nominal with watch; suspects open after
    two diagnosed warnings in a row.  ``verdicts`` has status and diagnosed."""
    w = Window.partitionBy(key).orderBy(*order)
    warning = F.col("status") == "WARNING"
    block = F.sum(F.when(warning & F.col("diagnosed"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = verdicts.withColumn("__b", block)
    streak = F.sum(F.when((F.col("status") == "WARNING") & F.col("diagnosed"), 1).otherwise(0)).over(
        Window.partitionBy(key, "__b").orderBy(*order)
    )
    marked = marked.withColumn("suspect_streak", streak).drop("__b")
    shown = (
        F.when(F.col("status") == "ANOMALY", "fault")
        .when((F.col("status") == "WARNING") & F.col("diagnosed") & (F.col("suspect_streak") >= 2), "suspect")
        .otherwise("nominal")
    )
    return marked.withColumn("shown", shown).withColumn("watch", (F.col("status") == "WARNING") & (shown == "nominal"))


def status_events(verdicts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Events emitted when the shown status changes: WEATHER, ANOMALY, RECOVERED, UPDATED."""
    w = Window.partitionBy(key).orderBy(*order)
    before, now = F.coalesce(F.lag("shown").over(w), F.lit("nominal")), F.col("shown")
    events = F.array_compact(
        F.array(
            F.when((now == "weather_event") & (before != now), "WEATHER_EVENT"),
            F.when(now.isin("fault", "suspect") & (before != now), "ANOMALY_DETECTED"),
            F.when((now == "nominal") & (before != now), "STATION_RECOVERED"),
            F.lit("STATION_UPDATED"),
        )
    )
    return verdicts.withColumn("__events", events).withColumn("event", F.explode("__events")).drop("__events")


def incident_sessions(snapshots: DataFrame, keys: list[str], order: list[str], closes: Column) -> DataFrame:
    """Numbers the incidents of each key: a snapshot after a closing one opens the next."""
    w = Window.partitionBy(*keys).orderBy(*order)
    closed_before = F.coalesce(F.lag(closes.cast("int")).over(w), F.lit(0))
    return snapshots.withColumn("incident_no", F.sum(closed_before).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def folded_incidents(sessions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each incident: first observation kept, the rest from the last snapshot,
    with counts of diagnosis revisions and severity rises on the way."""
    keys = [*keys, "incident_no"]
    w = Window.partitionBy(*keys).orderBy(*order)
    steps = sessions.withColumn(
        "revised", F.coalesce((F.lag("root_cause").over(w) != F.col("root_cause")).cast("int"), F.lit(0))
    ).withColumn("raised", F.coalesce((F.col("severity") > F.lag("severity").over(w)).cast("int"), F.lit(0)))
    at = F.struct(*order)
    return steps.groupBy(*keys).agg(
        F.min_by("observed_at", at).alias("first_observation_at"),
        F.max_by("observed_at", at).alias("last_observation_at"),
        F.max_by("severity", at).alias("severity"),
        F.max_by("root_cause", at).alias("root_cause"),
        F.sum("revised").alias("revisions"),
        F.sum("raised").alias("escalations"),
        F.count("*").alias("observations"),
    )


def throttled(sessions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incident events: created first, then updated on a new severity or each fifth time."""
    w = Window.partitionBy(*keys, "incident_no").orderBy(*order)
    n = F.row_number().over(w)
    event = F.when(n == 1, "CREATED").when((F.lag("severity").over(w) != F.col("severity")) | (n % 5 == 0), "UPDATED")
    return sessions.withColumn("event", event).where("event is not null")


def lifecycle_stages(timeline: DataFrame, key: str, stages: dict[str, list[str]]) -> DataFrame:
    """The first time that an incident entered each stage, as columns."""
    return timeline.groupBy(key).agg(*[F.min(F.when(F.col("event").isin(*names), F.col("at"))).alias(stage) for stage, names in stages.items()])


def staleness(last_received: DataFrame, now: Column, cadence_s: float) -> DataFrame:
    """LIVE, STALE over three cadences, OUTAGE over five."""
    age = now - F.col("received_s")
    state = F.when(age > 5 * cadence_s, "OUTAGE").when(age > 3 * cadence_s, "STALE").otherwise("LIVE")
    return last_received.withColumn("age_s", age).withColumn("state", state)
