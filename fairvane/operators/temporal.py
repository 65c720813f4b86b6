"""Per-station window operators: step rate, frozen runs, robust z, streaks, sessions.

All windows of one station share a partitioning and an order, so a plan that uses
several has one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    FROZEN_EPSILON,
    FROZEN_HUMIDITY_EXEMPT,
    FROZEN_MINUTES,
    FROZEN_READINGS,
    MAD_FLOOR,
    MAX_STEP,
    MIN_HISTORY,
    STEP_SECONDS,
    WINDOW,
    Z_LIMIT,
)


def ordered(station: str = "station_id", time: str = "observed_at", tie: str = "event_id"):
    return Window.partitionBy(station).orderBy(time, tie)


def seconds(time: Column) -> Column:
    """Seconds since the epoch of a time, with or without zone."""
    return F.unix_micros(time.cast("timestamp")) / 1e6


def step_score(channel: str, value: Column, time: Column, w) -> Column:
    """How far a step from the previous reading exceeds what its time span allows."""
    delta = F.abs(value - F.lag(value).over(w))
    gap = F.greatest(F.lit(1.0), F.abs(seconds(time) - seconds(F.lag(time).over(w))))
    limit = F.lit(MAX_STEP[channel]) * F.greatest(F.lit(0.5), F.least(F.lit(3.0), gap / STEP_SECONDS))
    return F.when(delta > limit, F.least(F.lit(1.0), delta / (1.8 * limit))).otherwise(0.0)


def with_frozen(df: DataFrame, channel: str, w, time: str = "observed_at") -> DataFrame:
    """Adds run_length, run_minutes and frozen_score of the trailing run of equal values."""
    value = F.col(channel)
    changed = F.when(F.abs(value - F.lag(value).over(w)) < FROZEN_EPSILON, 0).otherwise(1)
    marked = df.withColumn("__run", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("station_id", "__run").orderBy(time, "event_id")
    out = marked.withColumn("run_length", F.least(F.row_number().over(run), F.lit(WINDOW)))
    started = F.first(time).over(run.rowsBetween(-(WINDOW - 1), 0))
    out = out.withColumn("run_minutes", (seconds(F.col(time)) - seconds(started)) / 60)
    frozen = (F.col("run_length") >= FROZEN_READINGS) & (F.col("run_minutes") >= FROZEN_MINUTES) & value.isNotNull()
    if channel == "humidity":
        frozen = frozen & (value < FROZEN_HUMIDITY_EXEMPT)
    return out.withColumn("frozen_score", F.when(frozen, 0.95).otherwise(0.0)).drop("__run")


def with_modified_z(df: DataFrame, channel: str, w) -> DataFrame:
    """Adds median, mad and z_score against the last 72 values, the current one included."""
    frame = w.rowsBetween(-(WINDOW - 1), 0)
    value = F.col(channel)
    history = df.withColumn("__history", F.collect_list(value).over(frame)).withColumn(
        "median", F.percentile(value, F.lit(0.5)).over(frame)
    )
    spread = F.array_sort(F.transform("__history", lambda x: F.abs(x - F.col("median"))))
    size = F.size(spread)
    low, high = F.get(spread, F.floor((size - 1) / 2).cast("int")), F.get(spread, F.floor(size / 2).cast("int"))
    out = history.withColumn("mad", (low + high) / 2)
    varied = (F.col("mad") > 1e-3) | (F.size(F.array_distinct(F.transform("__history", lambda x: F.round(x, 6)))) > 1)
    z = 0.6745 * F.abs(value - F.col("median")) / F.greatest(F.col("mad"), F.lit(MAD_FLOOR[channel]))
    ready = (F.size("__history") >= MIN_HISTORY) & value.isNotNull() & varied
    out = out.withColumn("z", F.when(ready, z))
    score = F.when(F.col("z") > Z_LIMIT, F.least(F.lit(1.0), (F.col("z") - Z_LIMIT) / 3 + 0.6)).otherwise(0.0)
    return out.withColumn("z_score", score).drop("__history")


def status_of(score: Column) -> Column:
    return F.when(score >= 0.7, "ANOMALY").when(score >= 0.4, "WARNING").otherwise("NORMAL")


def with_sessions(df: DataFrame, w, max_gap_min: float = 15.0, time: str = "observed_at") -> DataFrame:
    """Adds session (numbered from 0) and position, cut at long gaps and at times going back."""
    gap = (seconds(F.col(time)) - seconds(F.lag(time).over(w))) / 60
    cut = F.when((gap > max_gap_min) | (gap <= 0), 1).otherwise(0)
    out = df.withColumn("session", F.sum(cut).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("station_id", "session").orderBy(time, "event_id")
    return out.withColumn("position", F.row_number().over(inside))


def with_streak(df: DataFrame, condition: Column, w, name: str = "streak") -> DataFrame:
    """Adds the number of rows in a row, up to this one, that meet the condition."""
    marked = df.withColumn("__hit", condition).withColumn(
        "__block", F.sum(F.when(F.col("__hit"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    inside = Window.partitionBy("station_id", "__block").orderBy("observed_at", "event_id")
    count = F.sum(F.when(F.col("__hit"), 1).otherwise(0)).over(inside)
    return marked.withColumn(name, F.when(F.col("__hit"), count).otherwise(F.lit(0))).drop("__hit", "__block")


def recent_peak(score: Column, w, readings: int = 6) -> Column:
    return F.max(score).over(w.rowsBetween(-(readings - 1), 0))


def rolling_median(value: Column, w, readings: int = 36, least: int = 3) -> Column:
    """Median of the readings before this one; null with fewer than ``least``."""
    frame = w.rowsBetween(-readings, -1)
    return F.when(F.count(value).over(frame) >= least, F.percentile(value, F.lit(0.5)).over(frame))


def trend(value: Column, x: Column, w, readings: int = 144, least: int = 12) -> Column:
    """Least-squares slope of the last readings; null with fewer than ``least``."""
    frame = w.rowsBetween(-(readings - 1), 0)
    return F.when(F.count(value).over(frame) >= least, F.regr_slope(value, x).over(frame))


def noise_scale(value: Column, w, readings: int = 12) -> Column:
    """Sample standard deviation of the first differences before this row: two passes."""
    return F.stddev_samp(value).over(w.rowsBetween(-readings, -1))


def stays_below(score: Column, w, readings: int = 6, limit: float = 0.5) -> Column:
    """Whether this and the following readings all stay below the limit."""
    frame = w.rowsBetween(0, readings - 1)
    return (F.count(score).over(frame) == readings) & (F.max(score).over(frame) < limit)


def sliding_windows(df: DataFrame, value: str, w, length: int, stride: int) -> DataFrame:
    """Full windows of the ``length`` readings before each ``stride``-th row."""
    frame = w.rowsBetween(-length, -1)
    out = df.withColumn("__rn", F.row_number().over(w)).withColumn("window", F.collect_list(value).over(frame))
    return out.where((F.size("window") == length) & ((F.col("__rn") - 1 - length) % stride == 0)).drop("__rn")


def longest_run(df: DataFrame, condition: Column, w) -> DataFrame:
    """station_id and the length of its longest run of rows that meet the condition."""
    return with_streak(df, condition, w).groupBy("station_id").agg(F.max("streak").alias("longest"))


def day_part(time: Column) -> tuple[Column, Column]:
    """Sine and cosine of the time of day."""
    angle = 2 * F.pi() * (F.hour(time) + F.minute(time) / 60) / 24
    return F.sin(angle), F.cos(angle)
