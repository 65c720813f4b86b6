"""Sensor drift: leaky CUSUM and exponential baseline over each station's ordered rows, tiers and trends."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CUSUM_H, CUSUM_K, CUSUM_LEAK, EMA_BETA, STEP_CLIP, STEP_SECONDS
from ..functions.physics import clip


def cusum_series(df: DataFrame, station: str, residual: str, time: str, tie: str, h: float = CUSUM_H, k: float = CUSUM_K) -> DataFrame:
    """EMA baseline and two-sided CUSUM of each station's residuals, row by row.

    Both recursions clamp or decay by the time since the last row, so they are no frame
    function.  Stations follow one another in sorted partitions, and a task holds the few
    numbers of one station's state, however long its series.
    """
    kinds = dict(df.dtypes)
    rows = df.where(F.col(residual).isNotNull()).select(
        F.col(station).alias("station"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.col(tie).alias("tie"), F.col(residual).cast("double").alias("r")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now, first = {}, None, 0
        for frame in frames:
            out = []
            for name, part in frame.groupby("station", sort=False, dropna=False):
                us = part["us"].to_numpy()
                if now is None or name != now:
                    state, now, first = {}, name, us[0]
                out += kernel(state, zip(((us - first) / 1e6).tolist(), part["r"].tolist()), h, k)
            scored = pd.DataFrame([x[1:] for x in out], columns=["ema", "up", "down", "score"])
            yield pd.concat([frame[["station", "tie"]].reset_index(drop=True), scored], axis=1)

    ordered = rows.repartition("station").sortWithinPartitions("station", "us", "tie")
    schema = f"station {kinds[station]}, tie {kinds[tie]}, ema double, up double, down double, score double"
    return ordered.mapInPandas(run, schema).withColumnsRenamed({"station": station, "tie": tie})


def drift_tier(cusum: Column, samples: Column, h: float = CUSUM_H) -> Column:
    return (
        F.when(samples < 6, "INSUFFICIENT")
        .when(cusum >= 1.5 * h, "CRITICAL")
        .when(cusum >= h, "HIGH")
        .when(cusum >= 0.6 * h, "MODERATE")
        .when(cusum >= 0.3 * h, "LOW")
        .otherwise("STABLE")
    )


def health(score: Column, error_rate: Column) -> Column:
    """Health index between 5 and 100."""
    return clip(100 - 35 * score - F.least(F.lit(40.0), 200 * error_rate), 5.0, 100.0)


def kendall(values: np.ndarray) -> tuple[float, float]:
    """Kendall's tau-b of a series against its order, and the asymptotic two-sided p-value."""
    n = len(values)
    if n < 2:
        return 0.0, 1.0
    s = np.sign(values[None, :] - values[:, None])[np.triu_indices(n, 1)].sum()
    _, ties = np.unique(values, return_counts=True)
    pairs = n * (n - 1) / 2
    tied = (ties * (ties - 1) / 2).sum()
    if pairs == tied:
        return 0.0, 1.0
    tau = s / math.sqrt(pairs * (pairs - tied))
    variance = (n * (n - 1) * (2 * n + 5) - (ties * (ties - 1) * (2 * ties + 5)).sum()) / 18
    z = s / math.sqrt(variance)
    return float(tau), math.erfc(abs(z) / math.sqrt(2))


def mann_kendall(df: DataFrame, station: str, value: str, order: list[str]) -> DataFrame:
    """station, n, tau and p for the stations given; costly, so filter to suspects first."""

    def test(batch: pd.DataFrame) -> pd.DataFrame:
        x = batch.sort_values(order)[value].dropna().to_numpy(float)[-144:]
        tau, p = kendall(x)
        return pd.DataFrame({station: [batch[station].iloc[0]], "n": [len(x)], "tau": [tau], "p": [p]})

    kind = dict(df.dtypes)[station]
    return df.groupBy(station).applyInPandas(test, f"{station} {kind}, n long, tau double, p double")


def suspect_trends(df: DataFrame, station: str, value: str, order: list[str], suspect: Column, last: int = 144, recent: int = 12, level: float = 0.01) -> DataFrame:
    """Trend of the last rows of stations whose ``suspect`` condition holds of the mean of their most recent ones.

    The condition is over ``bias``.  Only the rows that the test needs are brought together, at most ``last`` a
    station.  Gives station, n, tau and whether the trend is significant at ``level``.
    """
    newest = Window.partitionBy(station).orderBy(*[F.desc(x) for x in order])
    rows = df.where(F.col(value).isNotNull()).withColumn("__back", F.row_number().over(newest)).where(F.col("__back") <= last)
    bias = rows.where(F.col("__back") <= recent).groupBy(station).agg(F.avg(value).alias("bias")).where(suspect)
    found = mann_kendall(rows.join(bias.select(station), station, "left_semi").select(station, value, *order), station, value, order)
    return found.select(station, "n", "tau", (F.col("p") < level).alias("significant"))


def kernel(state: dict, rows: Iterator[tuple[float, float]], h: float = CUSUM_H, k: float = CUSUM_K) -> list[tuple]:
    """The same recursion for keyed streaming state: (seconds, residual) rows in order."""
    out = []
    for t, r in rows:
        last = state.get("t")
        gap = None if last is None else t - last
        w = 1.0 if gap is None or gap < 5 else min(STEP_CLIP, max(0.0, gap / STEP_SECONDS))
        keep, leak = EMA_BETA**w, CUSUM_LEAK**w
        state["ema"] = r if last is None else keep * state["ema"] + (1 - keep) * r
        state["up"] = max(0.0, state.get("up", 0.0) + (r - k) * w) * leak
        state["down"] = max(0.0, state.get("down", 0.0) + (-r - k) * w) * leak
        state["t"] = t
        out.append((t, state["ema"], state["up"], state["down"], min(1.0, max(state["up"], state["down"]) / (2 * h))))
    return out
