"""One keyed state machine for each station: freshness, alarms and the life of incidents.

A row is a reading that arrived, or an operator's action on the station's incident.  Readings that
are known already are duplicates, readings at or before the last time seen are late; both are given
out and neither is scored.  A lone or undiagnosed warning shows nominal with watch; diagnosed
warnings in a row make a suspect; faults and lasting suspects open an incident, which follows its
life cycle.  A station that falls silent becomes stale over three cadences after its last reading
arrived, and over five its link counts as out: in a stream timers say so, without any further row.

The machine (`Machine`) is plain Python over one station's state.  `machine_stream` runs it with
several state variables and event-time timers, `machine_batch` over a table.  Time is arrival
time, stamped when a row enters the log, so that a reading of any age is behind no watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.incidents import INCIDENT_EDGES

STALE_CADENCES, OUTAGE_CADENCES = 3, 5
#: Diagnosed warnings in a row that make a suspect, and abnormal readings in a row that open an incident.
SUSPECT_STREAK, DEBOUNCE = 2, 2
#: How long the ids of readings are remembered, in arrival time.
REMEMBERED_MS = 24 * 3600 * 1000
_ALLOWED = set(INCIDENT_EDGES)
_CLOSED = ("RESOLVED", "DISMISSED")

INPUT = ["received", "row_id", "kind", "observation_id", "observed_us", "source", "status", "diagnosed", "action", "cadence_s"]
EVENTS = (
    "station_id long, at_ms long, event string, observation_id string, shown string, watch boolean, "
    "streak int, freshness string, incident_no int, incident_status string"
)
_NAMES = [x.split()[0] for x in EVENTS.split(", ")]
CLOCK = "last_rx long, cadence long, freshness string"
ALARM = "last_us long, source string, streak int, abnormal int, shown string"
INCIDENT = "no int, status string"


class Machine:
    """State of one station and what a row or the passing of time makes of it."""

    def __init__(self, station_id, clock=(None, 0, "LIVE"), alarm=(-1, None, 0, 0, "nominal"), incident=(0, None)):
        self.station_id = station_id
        self.last_rx, self.cadence, self.freshness = clock
        self.last_us, self.source, self.streak, self.abnormal, self.shown = alarm
        self.no, self.incident = incident
        self.out: list[tuple] = []

    def clock(self) -> tuple:
        return self.last_rx, self.cadence, self.freshness

    def alarm(self) -> tuple:
        return self.last_us, self.source, self.streak, self.abnormal, self.shown

    def life(self) -> tuple:
        return self.no, self.incident

    def due(self) -> list[int]:
        """When silence will next matter, in milliseconds."""
        if self.last_rx is None:
            return []
        stale = self.last_rx + STALE_CADENCES * self.cadence + 1
        out = self.last_rx + OUTAGE_CADENCES * self.cadence + 1
        return {"LIVE": [stale, out], "STALE": [out]}.get(self.freshness, [])

    def _say(self, at_ms: int, event: str, observation_id: str | None = None, watch: bool = False) -> None:
        self.out.append((self.station_id, at_ms, event, observation_id, self.shown, watch, self.streak, self.freshness, self.no, self.incident))

    def silent_until(self, now_ms: int) -> None:
        """What silence has made of the station by ``now_ms``."""
        for at in self.due():
            if now_ms < at:
                return
            self.freshness = "STALE" if self.freshness == "LIVE" else "OUTAGE"
            self._say(at, "STATION_STALE" if self.freshness == "STALE" else "OUTAGE_OPENED")

    def row(self, at_ms: int, kind: str, observation_id, observed_us, source, status, diagnosed, action, cadence_s, known: bool) -> None:
        self.silent_until(at_ms)
        if kind == "action":
            self._act(at_ms, action)
            return
        before, self.freshness = self.freshness, "LIVE"
        self.last_rx, self.cadence = at_ms, int(cadence_s * 1000)
        if before == "OUTAGE":
            self._say(at_ms, "TELEMETRY_RESTORED", observation_id)
        if known:
            self._say(at_ms, "DUPLICATE", observation_id)
        elif observed_us <= self.last_us:
            self._say(at_ms, "LATE", observation_id)
        else:
            self._judge(at_ms, observation_id, int(observed_us), source, status, bool(diagnosed))

    def _judge(self, at_ms: int, observation_id, observed_us: int, source, status: str, diagnosed: bool) -> None:
        if self.source is not None and source != self.source:  # readings of another source are no continuation
            self.streak = self.abnormal = 0
        self.last_us, self.source = observed_us, source
        self.streak = self.streak + 1 if status == "WARNING" and diagnosed else 0
        before = self.shown
        self.shown = "fault" if status == "ANOMALY" else "suspect" if self.streak >= SUSPECT_STREAK else "nominal"
        unwell = self.shown != "nominal"
        self.abnormal = self.abnormal + 1 if unwell else 0
        watch = status == "WARNING" and not unwell
        self._say(at_ms, "STATION_UPDATED", observation_id, watch)
        if unwell and (before == "nominal" or (before, self.shown) == ("suspect", "fault")):
            self._say(at_ms, "ANOMALY_DETECTED", observation_id)
        elif not unwell and before != "nominal":
            self._say(at_ms, "STATION_RECOVERED", observation_id, watch)
        lasting = self.shown == "fault" or (unwell and self.abnormal >= DEBOUNCE)
        if lasting and (self.incident is None or self.incident in _CLOSED):
            self.no, self.incident = self.no + 1, "NEW"
            self._say(at_ms, "INCIDENT_CREATED", observation_id)

    def _act(self, at_ms: int, action: str) -> None:
        if self.incident is not None and (self.incident, action) in _ALLOWED:
            self.incident = action
            self._say(at_ms, f"INCIDENT_{action}")
        else:
            self._say(at_ms, "ACTION_REJECTED")

    def said(self) -> pd.DataFrame:
        out, self.out = self.out, []
        return pd.DataFrame(out, columns=_NAMES).astype({"at_ms": "int64", "streak": "int32", "incident_no": "int32", "watch": "bool"})


def _ordered(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    rows = pd.concat(list(frames)).sort_values(["received_ms", "row_id"])
    return zip(*(rows[n] for n in ["received_ms", *INPUT[2:]]))


class StationProcessor(StatefulProcessor):
    """``Machine`` over streaming state: clock, alarm, incident, and the ids of late memory."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", CLOCK)
        self.alarm = handle.getValueState("alarm", ALARM)
        self.incident = handle.getValueState("incident", INCIDENT)
        self.ids = handle.getMapState("ids", "id string", "at long")

    def _machine(self, station_id) -> Machine:
        held = [s.get() for s in (self.clock, self.alarm, self.incident) if s.exists()]
        return Machine(station_id, *held)

    def _keep(self, m: Machine) -> None:
        self.clock.update(m.clock()), self.alarm.update(m.alarm()), self.incident.update(m.life())

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        m = self._machine(int(key[0]))
        timers = set(m.due())
        for at, kind, observation_id, *rest in _ordered(rows):
            known = False
            if kind == "reading":
                known = self.ids.containsKey((observation_id,)) and self.ids.getValue((observation_id,))[0] >= at - REMEMBERED_MS
                self.ids.updateValue((observation_id,), (int(at),))
            m.row(int(at), kind, observation_id, *rest, known=known)
        for old in timers - set(m.due()):
            self.handle.deleteTimer(old)
        for new in set(m.due()) - timers:
            self.handle.registerTimer(new)
        self._keep(m)
        yield m.said()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        m, now = self._machine(int(key[0])), expiredTimerInfo.getExpiryTimeInMs()
        m.silent_until(now)
        for (i,), (at,) in list(self.ids.iterator()) if self.ids.exists() else []:
            if at < now - REMEMBERED_MS:
                self.ids.removeKey((i,))
        self._keep(m)
        yield m.said()

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    """Keyed state with several variables needs the store that keeps them on disk."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def _timed(rows: DataFrame) -> DataFrame:
    filled = {"observed_us": F.lit(0).cast("long"), "diagnosed": F.lit(False), "cadence_s": F.lit(0.0)}
    told = [F.coalesce(n, filled[n]).alias(n) if n in filled else F.col(n) for n in INPUT]
    return rows.select("station_id", *told, F.unix_millis("received").alias("received_ms"))


def machine_stream(rows: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Events of a stream of rows (station_id and ``INPUT``); ``delay`` bounds the disorder of arrival stamps."""
    with_state_store(rows.sparkSession)
    keyed = _timed(rows.withWatermark("received", delay)).groupBy("station_id")
    return keyed.transformWithStateInPandas(StationProcessor(), _schema(), "Append", "eventTime")


def machine_batch(rows: DataFrame, until_ms: int) -> DataFrame:
    """The same events of a table of rows, up to a time: stations one after the other in sorted partitions, one state held at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, ids = None, {}
        for frame in frames:
            for station, at, kind, observation_id, *rest in zip(*(frame[n] for n in ["station_id", "received_ms", *INPUT[2:]])):
                if m is None or station != m.station_id:
                    if m is not None:
                        m.silent_until(until_ms)
                        yield m.said()
                    m, ids = Machine(int(station)), {}
                known = kind == "reading" and ids.get(observation_id, -REMEMBERED_MS - 1) >= at - REMEMBERED_MS
                if kind == "reading":
                    ids[observation_id] = int(at)
                m.row(int(at), kind, observation_id, *rest, known=known)
            if m is not None:
                yield m.said()
                ids = {k: v for k, v in ids.items() if v >= m.last_rx - REMEMBERED_MS} if m.last_rx else ids
        if m is not None:
            m.silent_until(until_ms)
            yield m.said()

    sorted_ = _timed(rows).repartition("station_id").sortWithinPartitions("station_id", "received_ms", "row_id")
    return sorted_.mapInPandas(run, _schema())


def _schema() -> StructType:
    return StructType.fromDDL(EVENTS)
