"""Keyed history of each station: the temporal layer as state, in a stream or over a batch.

The state of a station and channel is its last 72 values with their times and the length
of a flagged frozen run.  When such a run ends, its samples leave the history, so a stuck
sensor does not become its own baseline.  Rows at or before the last time seen are late:
they are given out unscored.  The state starts anew when the station's source changes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import FROZEN_EPSILON, FROZEN_MINUTES, FROZEN_READINGS, MAD_FLOOR, MIN_HISTORY, WINDOW, Z_LIMIT

STATE = "values array<double>, times array<double>, frozen int, last_us long, source string"
SCORED = "station_id long, event_id long, late boolean, frozen_score double, z_score double, purged int, history int"


def kernel(held: dict, readings: Iterable[tuple[float, float | None]], floor: float) -> Iterator[tuple[float, float, int, int]]:
    """(frozen score, z score, samples purged, values held) of each (time in seconds, value), in order.

    ``held`` has values, times and frozen, and is carried on.
    """
    values, times = deque(held.get("values", ()), WINDOW), deque(held.get("times", ()), WINDOW)
    frozen = held.get("frozen", 0)
    for t, value in readings:
        purged = 0
        if value is None or value != value:
            yield 0.0, 0.0, 0, len(values)
            continue
        if frozen and values and abs(value - values[-1]) >= FROZEN_EPSILON:
            purged = min(frozen, len(values))
            for _ in range(purged):
                values.pop(), times.pop()
            frozen = 0
        values.append(value)
        times.append(t)
        history = np.array(values)
        changes = np.nonzero(np.abs(np.diff(history)) >= FROZEN_EPSILON)[0]
        start = int(changes[-1]) + 1 if len(changes) else 0
        run = len(history) - start
        stuck = run >= FROZEN_READINGS and (t - times[start]) / 60 >= FROZEN_MINUTES
        frozen = run if stuck else frozen
        score = 0.0
        if len(history) >= MIN_HISTORY:
            median = float(np.median(history))
            mad = float(np.median(np.abs(history - median)))
            if mad > 1e-3 or len(np.unique(np.round(history, 6))) > 1:
                z = 0.6745 * abs(value - median) / max(mad, floor)
                score = min(1.0, (z - Z_LIMIT) / 3 + 0.6) if z > Z_LIMIT else 0.0
        yield (0.95 if stuck else 0.0), score, purged, len(values)
    held.update(values=list(values), times=list(times), frozen=frozen)


class Station:
    """The state of one station: its history, the last time seen and its source."""

    def __init__(self, values=(), times=(), frozen: int = 0, last_us: int = -1, source: str | None = None):
        self.held = {"values": list(values), "times": list(times), "frozen": frozen}
        self.last_us, self.source = last_us, source

    def saved(self) -> tuple:
        return self.held["values"], self.held["times"], self.held["frozen"], int(self.last_us), self.source

    def scored(self, station_id, event_id, at_us: int, source: str, value: float | None, floor: float) -> tuple:
        if at_us <= self.last_us:
            return station_id, event_id, True, None, None, None, None
        if self.source is not None and source != self.source:
            self.held = {"values": [], "times": [], "frozen": 0}
        self.source, self.last_us = source, at_us
        ((frozen_score, z_score, purged, n),) = kernel(self.held, [(at_us / 1e6, value)], floor)
        return station_id, event_id, False, frozen_score, z_score, purged, n


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in SCORED.split(", ")])
    return frame.astype({"late": "boolean", "frozen_score": "Float64", "z_score": "Float64", "purged": "Int32", "history": "Int32"})


def _readings(rows: pd.DataFrame, channel: str) -> Iterator[tuple]:
    return zip(rows["station_id"], rows["event_id"], rows["observed_us"], rows["source"], rows[channel])


def _narrow(observations: DataFrame, channel: str) -> DataFrame:
    """station_id, event_id, observed_us, source and the channel."""
    return observations.select("station_id", "event_id", "observed_us", "source", channel)


def history_stream(observations: DataFrame, channel: str) -> DataFrame:
    """Scores of ``channel`` from keyed history of a stream; batches may come late and out of order."""
    floor = MAD_FLOOR[channel]

    def scored(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        station = Station(*state.get) if state.exists else Station()
        rows = pd.concat(list(batches)).sort_values(["observed_us", "event_id"])
        out = [station.scored(*reading, floor) for reading in _readings(rows, channel)]
        state.update(station.saved())
        yield _frame(out)

    return _narrow(observations, channel).groupBy("station_id").applyInPandasWithState(
        scored, SCORED, STATE, "append", GroupStateTimeout.NoTimeout
    )


def history_batch(observations: DataFrame, channel: str) -> DataFrame:
    """The same scores of a table: stations one after the other in sorted partitions, one state held at a time."""
    floor = MAD_FLOOR[channel]
    order = ["station_id", "observed_us", "event_id"]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        station, now = Station(), None
        for rows in batches:
            out = []
            for reading in _readings(rows, channel):
                if reading[0] != now:
                    station, now = Station(), reading[0]
                out.append(station.scored(*reading, floor))
            yield _frame(out)

    return _narrow(observations, channel).repartition("station_id").sortWithinPartitions(*order).mapInPandas(scored, SCORED)
