"""Drift of each station, channel and kind of reference, as keyed state in a stream or over a table.

A residual against the neighbours' consensus, against a background model and the raw value
are different series: each has a state of its own, so a change of reference mixes nothing.
Humidity near saturation says nothing about the sensor and is suspended.  Rows at or before
the last time seen are late and given out unscored.  The state starts anew when the
station's source changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..constants import CUSUM_H, CUSUM_K, DRIFT_MULTIPLIERS
from ..durable import durable
from ..operators.drift import kernel
from .stations import with_state_store

SATURATED = 95.0
KEY = ["station_id", "channel", "mode"]
STATE = "t double, ema double, up double, down double, last_us long, source string"
SCORED = "station_id long, channel string, mode string, event_id long, late boolean, ema double, up double, down double, score double"
_HELD = ("t", "ema", "up", "down")


def reference_mode(channel: Column, value: Column, consensus: Column, background: Column) -> Column:
    """SPATIAL where there is a consensus, else BACKGROUND, else RAW; SUSPENDED_SATURATION for humid air."""
    reference = F.coalesce(consensus, background)
    saturated = (channel == "humidity") & (F.greatest(value, reference) >= SATURATED) & reference.isNotNull()
    return (
        F.when(saturated, "SUSPENDED_SATURATION")
        .when(consensus.isNotNull(), "SPATIAL")
        .when(background.isNotNull(), "BACKGROUND")
        .otherwise("RAW")
    )


def channel_residuals(readings: DataFrame) -> DataFrame:
    """Mode and residual of readings in long form (channel, value, consensus, background); absent values go."""
    mode = reference_mode(F.col("channel"), F.col("value"), F.col("consensus"), F.col("background"))
    residual = F.col("value") - F.coalesce("consensus", "background", F.lit(0.0))
    return readings.where("value is not null").select(
        "station_id", "channel", mode.alias("mode"), "event_id", "observed_us", "source", residual.alias("residual")
    )


class Series:
    """The state of one station, channel and mode."""

    def __init__(self, channel: str, t=None, ema=None, up=None, down=None, last_us: int = -1, source: str | None = None):
        slack, threshold = DRIFT_MULTIPLIERS[channel]
        self.k, self.h = CUSUM_K * slack, CUSUM_H * threshold
        self.held = {n: v for n, v in zip(_HELD, (t, ema, up, down)) if v is not None}
        self.last_us, self.source = last_us, source

    def saved(self) -> tuple:
        return (*(self.held.get(n) for n in _HELD), int(self.last_us), self.source)

    def scored(self, event_id: int, at_us: int, source: str, residual: float) -> tuple:
        if at_us <= self.last_us:
            return event_id, True, None, None, None, None
        if self.source is not None and source != self.source:
            self.held = {}
        self.source, self.last_us = source, at_us
        ((_, ema, up, down, score),) = kernel(self.held, iter([(at_us / 1e6, residual)]), self.h, self.k)
        return event_id, False, ema, up, down, score


def _rows(frame: pd.DataFrame) -> Iterator[tuple]:
    return zip(*(frame[n] for n in [*KEY, "event_id", "observed_us", "source", "residual"]))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in SCORED.split(", ")]).astype({"late": "boolean"})


def channel_drift_stream(residuals: DataFrame) -> DataFrame:
    """Scores of a stream of ``channel_residuals``; suspended rows are left out."""

    def scored(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        series = Series(key[1], *(state.get if state.exists else ()))
        rows = pd.concat(list(batches)).sort_values(["observed_us", "event_id"])
        out = [(*row[:3], *series.scored(*row[3:])) for row in _rows(rows)]
        state.update(series.saved())
        yield _frame(out)

    some = residuals.where("mode <> 'SUSPENDED_SATURATION'")
    return some.groupBy(*KEY).applyInPandasWithState(scored, SCORED, STATE, "append", GroupStateTimeout.NoTimeout)


def channel_drift_batch(residuals: DataFrame) -> DataFrame:
    """The same scores of a table: series one after the other in sorted partitions, one state held at a time."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, now = None, None
        for frame in batches:
            out = []
            for row in _rows(frame):
                if row[:3] != now:
                    series, now = Series(row[1]), row[:3]
                out.append((*now, *series.scored(*row[3:])))
            yield _frame(out)

    some = residuals.where("mode <> 'SUSPENDED_SATURATION'")
    return some.repartition(*KEY).sortWithinPartitions(*KEY, "observed_us", "event_id").mapInPandas(scored, SCORED)


class _Drift(StatefulProcessor):
    """``Series`` over streaming state, which a stored tail can seed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("series", STATE)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.iloc[0]
        numbers = [None if pd.isna(row[n]) else float(row[n]) for n in _HELD]
        self.held.update((*numbers, int(row["last_us"]), None if pd.isna(row["source"]) else str(row["source"])))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        series = Series(key[1], *(self.held.get() if self.held.exists() else ()))
        ordered = pd.concat(list(rows)).sort_values(["observed_us", "event_id"])
        out = [(*row[:3], *series.scored(*row[3:])) for row in _rows(ordered)]
        self.held.update(series.saved())
        yield _frame(out)

    def close(self) -> None:
        pass


def seeds(residuals: DataFrame, scored: DataFrame, since_us: int) -> DataFrame:
    """The state of each series after its last stored score, where that is not older than ``since_us``.

    ``residuals`` and ``scored`` are stored tables; older series start anew, as they would after the gap.
    """
    tail = residuals.where(F.col("observed_us") >= since_us).select(*KEY, "event_id", "observed_us", "source")
    known = scored.where("not late").select(*KEY, "event_id", "ema", "up", "down").join(tail, [*KEY, "event_id"])
    state = F.struct((F.col("observed_us") / 1e6).alias("t"), "ema", "up", "down", F.col("observed_us").alias("last_us"), "source")
    return known.groupBy(*KEY).agg(F.max_by(state, F.struct("observed_us", "event_id")).alias("s")).select(*KEY, "s.*")


def recovered_stream(residuals: DataFrame, seeded: DataFrame) -> DataFrame:
    """``channel_drift_stream`` that goes on from ``seeds`` instead of from nothing.

    The seeds are stored first: only the first micro-batch of a query reads them.
    """
    with_state_store(residuals.sparkSession)
    some = residuals.where("mode <> 'SUSPENDED_SATURATION'").select(*KEY, "event_id", "observed_us", "source", "residual")
    return some.groupBy(*KEY).transformWithStateInPandas(
        _Drift(), StructType.fromDDL(SCORED), "Append", "none", initialState=durable(seeded).groupBy(*KEY)
    )
