"""Joint consistency of a reading: how far each channel is from what the others lead one to expect.

A low-rank linear model of temperature, pressure, humidity and height stands for the neural one of
the inventory: principal components from sums of cross products, one aggregation over all rows.  A
reading is projected on the components by the channels it has, and reconstructed.  The score ramps
with the worst deviation in tolerances and stays a secondary, capped signal.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNELS = ("temperature", "pressure", "humidity")
#: Tolerances (pressure: percent of the expected value), the ramp in tolerances, and the cap.
TOLERANCE = {"temperature": 3.5, "pressure": 6.0, "humidity": 12.0}
RAMP, CAP, RIDGE = (2.0, 5.0), 0.55, 1e-3


@dataclass(frozen=True)
class Components:
    """Mean, spread and loadings of the channels and the height (last)."""

    mean: tuple[float, ...]
    spread: tuple[float, ...]
    loadings: tuple[tuple[float, ...], ...]

    def weights(self, seen: tuple[int, ...]) -> np.ndarray:
        """Standardised reconstruction of all inputs from those that are ``seen``."""
        c = np.array(self.loadings).T  # inputs by components
        some = c[list(seen)]
        return c @ np.linalg.solve(some.T @ some + RIDGE * np.eye(c.shape[1]), some.T)

    def formula(self, channel: int, seen: tuple[int, ...]) -> tuple[float, dict[int, float]]:
        """The expected value of a channel as a constant and a factor for each input that is seen."""
        w = self.weights(seen)[channel] * self.spread[channel]
        factors = {i: float(w[j] / self.spread[i]) for j, i in enumerate(seen)}
        return float(self.mean[channel] - sum(f * self.mean[i] for i, f in factors.items())), factors


def fitted(rows: DataFrame, height: str = "elevation", rank: int = 2) -> Components:
    """Components of the rows that have all inputs; only sums come to the driver."""
    names = [*CHANNELS, height]
    whole = rows.dropna(subset=names)
    sums = [F.sum(n) for n in names] + [F.sum(F.col(a) * F.col(b)) for a in names for b in names]
    found = whole.agg(F.count("*"), *sums).first()
    n, k = max(found[0], 1), len(names)
    mean = np.array([x or 0.0 for x in found[1 : k + 1]]) / n
    cov = np.array([x or 0.0 for x in found[k + 1 :]]).reshape(k, k) / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    _, vectors = np.linalg.eigh(cov / np.outer(spread, spread))
    best = vectors[:, ::-1][:, :rank].T
    best = best * np.where(best[np.arange(rank), np.abs(best).argmax(axis=1)] < 0, -1, 1)[:, None]  # one sign, so that fits compare
    return Components(tuple(mean.tolist()), tuple(spread.tolist()), tuple(map(tuple, best.tolist())))


def patterns() -> list[tuple[int, ...]]:
    """The sets of channels that a reading may have, two at least, with the height."""
    return [(*s, 3) for size in (3, 2) for s in itertools.combinations(range(3), size)]


def expected(model: Components, channel: int, height: str = "elevation") -> Column:
    """What the channels of a reading lead one to expect of one of them; null with fewer than two."""
    names, out = [*CHANNELS, height], None
    for seen in patterns():
        constant, factors = model.formula(channel, seen)
        value = F.lit(constant)
        for i, f in factors.items():
            value = value + F.lit(f) * (F.col(names[i]) if i < 3 else F.coalesce(names[i], F.lit(0.0)))
        has = F.lit(True)
        for i in range(3):
            has = has & (F.col(names[i]).isNotNull() if i in seen else F.col(names[i]).isNull())
        out = F.when(has, value) if out is None else out.when(has, value)
    return out


def scored(rows: DataFrame, model: Components, height: str = "elevation") -> DataFrame:
    """``rows`` with expected values, the worst channel and the score; no score for fewer than two channels."""
    out = rows.withColumns({f"expected_{c}": F.when(F.col(c).isNotNull(), expected(model, i, height)) for i, c in enumerate(CHANNELS)})
    far = {}
    for c in CHANNELS:
        by = F.lit(TOLERANCE[c])
        if c == "pressure":
            by = F.greatest(F.lit(1e-3), F.abs("expected_pressure")) * TOLERANCE[c] / 100
        far[c] = F.coalesce(F.abs(F.col(c) - F.col(f"expected_{c}")) / by, F.lit(0.0))
    worst = F.greatest(*far.values())
    name = F.when(worst > 0, F.when(far["temperature"] == worst, "temperature").when(far["pressure"] == worst, "pressure").otherwise("humidity"))
    ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (worst - RAMP[0]) / (RAMP[1] - RAMP[0])))
    return out.withColumn("worst", name).withColumn("consistency", ramp * CAP)
