"""Scores of how far each reading is from what the readings before it lead one to expect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from .multivariate import next_step_residuals
from .quantiles import quantiles

#: Fixed value: what the scaled residuals are divided by, so that calm stations stay low.
CALIBRATION_FACTOR = 1.44


def next_step_scores(
    df: DataFrame,
    station: str,
    order_by: Sequence[str],
    channels: Sequence[str],
    history: int = 144,
    order: int = 3,
    calibrating: Column | None = None,
    ridge: float = 1.0,
    factor: float = CALIBRATION_FACTOR,
) -> DataFrame:
    """``df`` with a residual and a score for each channel, the ``next_step_score`` and why it is missing.

    A reading is predicted from the ``order`` readings before it that hold all channels; the predictor
    (ridge, one for each channel) is fitted over all rows.  A score is the absolute residual over its 99th
    percentile on the ``calibrating`` rows (all, if None), over ``factor``, at most one; the next step score
    is the largest.  ``skip_reason`` is ``current_observation_incomplete`` where a channel is null or NaN,
    else ``insufficient_valid_history`` with fewer than ``history`` whole readings before.  Null flags don't
    calibrate.  A channel without a positive percentile scores one for any residual and zero for none.
    """
    if history < order:
        raise ValueError("a prediction needs as much history as its order")
    clean = df.select("*", *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"__{c}") for c in channels])
    complete = F.lit(True)
    for c in channels:
        complete = complete & F.col(f"__{c}").isNotNull()
    clean = clean.withColumn("__complete", complete)
    run = Window.partitionBy(station).orderBy(*order_by)
    rows = clean.where("__complete").withColumn("__before", F.row_number().over(run) - 1)
    for c in channels:
        rows, _ = next_step_residuals(rows, f"__{c}", run, order, ridge)
        rows = rows.withColumnRenamed("residual", f"{c}_residual")
    ready = F.col("__before") >= history
    rows = durable(rows.select("*", *[F.when(ready, F.col(f"{c}_residual")).alias(f"__r_{c}") for c in channels]))
    fit = rows if calibrating is None else rows.where(calibrating)
    sizes = F.array(*[F.struct(F.lit(c).alias("channel"), F.abs(f"__r_{c}").alias("size")) for c in channels])
    limits = {r.channel: r.p99 for r in quantiles(fit.select(F.inline(sizes)), ["channel"], "size", {"p99": 0.99}).collect()}  # a row a channel

    def score(c: str) -> Column:
        size, limit = F.abs(f"__r_{c}"), float(limits.get(c) or 0.0)
        return F.when(size.isNotNull(), F.least(size / limit / factor, F.lit(1.0))) if limit > 0 else F.when(size > 0, 1.0).when(size == 0, 0.0)

    scored = rows.select(
        *df.columns, *[F.col(f"__r_{c}").alias(f"{c}_residual") for c in channels], *[score(c).alias(f"{c}_score") for c in channels],
        F.when(~ready, "insufficient_valid_history").alias("skip_reason"),
    )
    best = F.greatest(*[F.col(f"{c}_score") for c in channels]) if len(channels) > 1 else F.col(f"{channels[0]}_score")
    scored = scored.withColumn("next_step_score", best)
    rest = clean.where("NOT __complete").select(*df.columns, F.lit("current_observation_incomplete").alias("skip_reason"))
    return scored.unionByName(rest, allowMissingColumns=True)
