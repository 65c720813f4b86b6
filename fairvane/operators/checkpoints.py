"""What residuals do over injected cases, and whether a data set is fit to learn from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from .quantiles import quantiles


def case_figures(scored: DataFrame, cases: DataFrame, threshold: float, checkpoints: Sequence[int]) -> DataFrame:
    """One row of figures for each case.

    ``scored`` has case_id, step (one row each), residual and score (null where there is none); ``cases``
    has case_id, kind, start and duration, in steps.  A case without rows keeps its row.

    ``onset``, ``near_end`` and ``largest`` are of the residuals that exist inside the case, ``after_<n>`` is
    the residual n steps in, or at the end of a shorter case.  ``persists`` tells whether the case's last
    score is over the threshold (null without a residual), ``crossed`` whether any is.
    ``unavailable_share`` is the part of the case's rows without a residual, ``unavailable_run`` how many
    rows from the start on have none, beyond the case's end too.  NaN is no value.
    """
    inside = F.col("step").between(F.col("start"), F.col("end"))
    told = scored.select("case_id", "step", F.nanvl("residual", F.lit(None)).alias("residual"), F.nanvl("score", F.lit(None)).alias("score"))
    rows = cases.select("case_id", "kind", "start", (F.col("start") + F.col("duration") - 1).alias("end")).join(told, "case_id", "left")
    late = F.col("step") >= F.col("start")
    place = F.sum(late.cast("long")).over(Window.partitionBy("case_id").orderBy("step"))
    rows = rows.withColumn("place", place)
    here, scores = inside & F.col("residual").isNotNull(), inside & F.col("score").isNotNull()
    over = F.col("score") > threshold

    def where(condition: Column, value: str | Column) -> Column:
        return F.when(condition, F.col(value) if isinstance(value, str) else value)

    first_there = F.min(where(late & F.col("residual").isNotNull(), "place"))
    last_over = F.coalesce(F.max_by(where(scores, over), where(scores, "step")), F.lit(False))
    return rows.groupBy("case_id", "kind").agg(
        F.min_by("residual", where(here, "step")).alias("onset"),
        F.max(where(here, "residual")).alias("largest"),
        F.max_by("residual", where(here, "step")).alias("near_end"),
        *[F.max(where(F.col("step") == F.least(F.col("start") + n, F.col("end")), "residual")).alias(f"after_{n}") for n in checkpoints],
        F.when(F.max(here.cast("int")) == 1, last_over).alias("persists"),
        F.coalesce(F.max(where(scores, over)), F.lit(False)).alias("crossed"),
        F.avg(where(inside, F.col("residual").isNull().cast("double"))).alias("unavailable_share"),
        F.coalesce(first_there - 1, F.max("place"), F.lit(0)).alias("unavailable_run"),
    )


def checkpoint_summary(scored: DataFrame, cases: DataFrame, threshold: float, checkpoints: Sequence[int]) -> DataFrame:
    """kind, figure, n, mean, median, p95 and largest of ``case_figures`` over the cases of a kind.

    Cases without a figure don't count in it; truths are one and zero, so their mean is a fraction.
    Quantiles are selected, so no kind's cases meet in one buffer.
    """
    each = case_figures(scored, cases, threshold, checkpoints)
    names = [n for n in each.columns if n not in ("case_id", "kind")]
    long = each.select("kind", F.explode(F.array(*[F.struct(F.lit(n).alias("figure"), F.col(n).cast("double").alias("value")) for n in names])).alias("x"))
    long = durable(long.select("kind", "x.figure", "x.value").where("value IS NOT NULL"))
    whole = long.groupBy("kind", "figure").agg(F.avg("value").alias("mean"), F.max("value").alias("largest"))
    parts = quantiles(long, ["kind", "figure"], "value", {"median": 0.5, "p95": 0.95})
    same = [whole[k].eqNullSafe(parts[k]) for k in ("kind", "figure")]
    return parts.join(whole, same).select(parts["kind"], parts["figure"], "n", "mean", "median", "p95", "largest")


def dataset_quality(
    df: DataFrame, station: str, at: str, split: str, bounds: Mapping[str, tuple[float, float]], spacing_seconds: float
) -> DataFrame:
    """(measure, n): rows, stations, repeated (station, time) rows, steps that are not the spacing, stations in
    several splits, and for each channel in ``bounds`` its missing and its outlying values.

    Steps are counted without ordering a station's rows, so a station with a third of all rows costs no
    task more than others: times are gathered in slots as long as the spacing; a right step leads from the
    last time of a slot to the first of the next, which is one equi-join, and every other step is wrong.
    Rows without a station or a time have no step; null splits don't count; NaN is missing.
    """
    length = round(spacing_seconds * 1e6)
    stamp = F.unix_micros(F.col(at).cast("timestamp"))
    rows = df.select(F.col(station).alias("s"), stamp.alias("t"), F.col(split).alias("split"), *[F.col(c).cast("double").alias(f"v_{c}") for c in bounds])
    missing = {c: F.col(f"v_{c}").isNull() | F.isnan(f"v_{c}") for c in bounds}
    outlying = {c: ~missing[c] & ~F.col(f"v_{c}").between(lo, hi) for c, (lo, hi) in bounds.items()}
    counts = rows.agg(
        F.count("*").alias("rows"),
        *[F.count_if(x).alias(f"missing_{c}") for c, x in missing.items()],
        *[F.count_if(x).alias(f"outlying_{c}") for c, x in outlying.items()],
    )
    by_station = rows.groupBy("s").agg(F.count("t").alias("timed"), F.min("split").alias("a"), F.max("split").alias("b")).where("s IS NOT NULL")
    stations = by_station.agg(
        F.count("*").alias("stations"),
        F.count_if(F.col("a") != F.col("b")).alias("split_overlap"),
        F.coalesce(F.sum(F.greatest(F.col("timed") - 1, F.lit(0))), F.lit(0)).alias("steps"),
    )
    times = rows.groupBy("s", "t").agg(F.count("*").alias("n"))
    repeated = times.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    slot = F.floor(F.col("t") / F.lit(length).cast("decimal(20,0)"))
    slots = times.where("s IS NOT NULL AND t IS NOT NULL").groupBy("s", slot.alias("slot")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    before = slots.select("s", (F.col("slot") + 1).alias("slot"), (F.col("last") + length).alias("first"))
    right = slots.join(before, ["s", "slot", "first"], "left_semi").agg(F.count("*").alias("right"))

    def measures(one: DataFrame, sign: int = 1, **renamed: str) -> DataFrame:
        pairs = [F.struct(F.lit(renamed.get(n, n)).alias("measure"), (F.col(n) * sign).cast("long").alias("n")) for n in one.columns]
        return one.select(F.inline(F.array(*pairs)))

    parts = [measures(counts), measures(stations, steps="wrong_steps"), measures(repeated), measures(right, -1, right="wrong_steps")]
    return reduce(DataFrame.unionAll, parts).groupBy("measure").agg(F.sum("n").alias("n"))
