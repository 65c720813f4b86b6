"""Multivariate outlier scores: gates, an isolation forest, next-step and cross-channel predictors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAD_TO_SIGMA
from ..durable import durable
from .quantiles import medians


def gate(valid: list[Column], convention: Column, elevation: Column, scope: Column) -> Column:
    """JOINT, PARTIAL or UNAVAILABLE: what the valid channels and the reference allow.

    Joint scores need all three channels, sea-level pressure (or a height to reduce it
    by) and a city baseline.
    """
    n = valid[0].cast("int")
    for v in valid[1:]:
        n = n + v.cast("int")
    reduced = F.coalesce((convention == "MSL") | ((convention == "SURFACE") & (elevation > 0)), F.lit(False))
    return F.when((n == 3) & reduced & (scope == "CITY"), "JOINT").when(n >= 2, "PARTIAL").otherwise("UNAVAILABLE")


def rule_score(zs: list[Column]) -> Column:
    """0 up to |z| = 3, 0.5 at 4.5, 1 from 8 on, of the channel furthest out."""
    worst = F.greatest(*[F.abs(z) for z in zs])
    return F.when(worst <= 3, 0.0).when(worst >= 8, 1.0).when(worst <= 4.5, (worst - 3) / 3).otherwise(0.5 + (worst - 4.5) / 7)


def robust_baseline(df: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Median and MAD of each channel by key, by selection; no group's values meet in one place."""
    middle = durable(medians(df, keys, channels, "_median"))
    apart = df.join(middle, keys).select(*keys, *[F.abs(F.col(c) - F.col(f"{c}_median")).alias(c) for c in channels])
    return middle.join(medians(apart, keys, channels, "_mad"), keys)


def standardised(df: DataFrame, baseline: DataFrame, keys: list[str], channels: list[str], floors: dict[str, float]) -> DataFrame:
    out = df.join(baseline, keys)
    for c in channels:
        scale = F.greatest(F.col(f"{c}_mad") * MAD_TO_SIGMA, F.lit(floors[c]))
        out = out.withColumn(f"{c}_z", (F.col(c) - F.col(f"{c}_median")) / scale)
    return out


class IsolationForest:
    """Random split trees on bounded samples; short average paths mean outliers."""

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 7):
        self.trees, self.sample, self.seed = trees, sample, seed
        self.roots: list[tuple] = []

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        size = min(self.sample, len(x))
        depth = math.ceil(math.log2(max(2, size)))
        self.size = size
        self.roots = [self._grow(x[rng.choice(len(x), size, replace=False)], depth, rng) for _ in range(self.trees)] if size else []
        return self

    def _grow(self, x: np.ndarray, depth: int, rng) -> tuple:
        spread = np.ptp(x, axis=0)
        if depth == 0 or len(x) <= 1 or not spread.any():
            return (len(x),)
        column = int(rng.choice(np.nonzero(spread)[0]))
        cut = float(rng.uniform(x[:, column].min(), x[:, column].max()))
        left = x[:, column] < cut
        return (column, cut, self._grow(x[left], depth - 1, rng), self._grow(x[~left], depth - 1, rng))

    @staticmethod
    def _expected(n: int) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; above 0.5 is unusual."""
        if not self.roots:
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))

        def walk(node: tuple, rows: np.ndarray, depth: int) -> None:
            if not len(rows):
                return
            if len(node) == 1:
                total[rows] += depth + self._expected(node[0])
                return
            left = x[rows, node[0]] < node[1]
            walk(node[2], rows[left], depth + 1)
            walk(node[3], rows[~left], depth + 1)

        for root in self.roots:
            walk(root, np.arange(len(x)), 0)
        return 2 ** (-total / len(self.roots) / max(self._expected(self.size), 1e-9))


def isolation_scores(df: DataFrame, key: str, channels: list[str], max_rows: int = 20_000) -> DataFrame:
    """key and isolation score; the forest is fitted on a bounded, hash-chosen sample."""
    fit_rows = df.select(*channels, F.xxhash64(key).alias("h")).dropna().orderBy("h").limit(max_rows).toPandas()
    forest = IsolationForest().fit(fit_rows[channels].to_numpy(float))
    kind = dict(df.dtypes)[key]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in channels]).astype(float)
            whole = ~np.isnan(x).any(axis=1)
            out = np.full(len(x), np.nan)
            out[whole] = forest.score(x[whole])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, from_pandas=True)], names=[key, "isolation"])

    return df.select(key, *channels).mapInArrow(score, f"{key} {kind}, isolation double")


def next_step_residuals(df: DataFrame, value: str, window, order: int = 3, ridge: float = 1.0) -> tuple[DataFrame, list[float]]:
    """Residual of each value to a ridge prediction from the ``order`` values before it.

    The normal equations are sums over all rows, one aggregation; only their few numbers
    come to the driver.
    """
    lags = [F.lag(value, i).over(window).alias(f"x{i}") for i in range(1, order + 1)]
    rows = df.select("*", *lags)
    full = rows.dropna(subset=[value, *[f"x{i}" for i in range(1, order + 1)]])
    names = ["1.0", *[f"x{i}" for i in range(1, order + 1)]]
    sums = [F.sum(F.expr(f"{a} * {b}")) for a in names for b in names] + [F.sum(F.expr(f"{a} * {value}")) for a in names]
    found = [float(x or 0.0) for x in full.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    k = order + 1
    weights = np.linalg.solve(np.array(found[: k * k]).reshape(k, k) + ridge * np.eye(k), np.array(found[k * k :])).tolist()
    guess = F.lit(weights[0])
    for i in range(1, order + 1):
        guess = guess + F.col(f"x{i}") * weights[i]
    return rows.withColumn("residual", F.col(value) - guess).drop(*[f"x{i}" for i in range(1, order + 1)]), weights
