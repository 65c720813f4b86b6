"""Empirical tail scores fitted on one table and asked for another, with calibrated anchors.

The fit is a table of distinct values with counts by channel.  To score, the values that are asked
are merged into it, and running sums over ranges give how many fitted values lie at or below, and
at or above, each of them; so a score is a look-up of values, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.physics import evidence
from .quantiles import quantiles
from .ranges import running

#: Percentiles of clean scores that mark no, half and full evidence.
ANCHORS = {"center": 0.95, "threshold": 0.995, "extreme": 0.9995}


def _long(rows: DataFrame, channels: list[str], *keep: str) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(x).alias("channel"), F.col(x).cast("double").alias("value")) for x in channels])
    return rows.select(*keep, F.inline(parts)).where("value is not null and not isnan(value)")


def fitted(rows: DataFrame, channels: list[str]) -> DataFrame:
    """Distinct values (channel, value) with their counts ``c``; rows that lack a channel take no part."""
    return _long(rows.dropna(subset=channels), channels).groupBy("channel", "value").agg(F.count("*").alias("c"))


def scored(rows: DataFrame, key: str, channels: list[str], fit: DataFrame) -> DataFrame:
    """key and ``raw``: the sum over channels of the larger -ln tail share, the row itself counted in.

    A row without all channels, or a channel without fitted values, gives null.
    """
    asked = _long(rows, channels, key)
    values = fit.unionByName(asked.select("channel", "value", F.lit(0).cast("long").alias("c")).distinct()).groupBy("channel", "value").agg(F.sum("c").alias("c"))
    sizes = fit.groupBy("channel").agg(F.sum("c").alias("n"))  # a row for each channel
    ranked = running(values, ["channel"], ["value"], "c").join(F.broadcast(sizes), "channel")
    below, above = F.col("upto") + 1, F.col("n") - F.col("upto") + F.col("c") + 1
    tails = ranked.select("channel", "value", F.greatest(-F.log(below / (F.col("n") + 1)), -F.log(above / (F.col("n") + 1))).alias("tail"))
    sums = asked.join(tails, ["channel", "value"]).groupBy(key).agg(F.sum("tail").alias("raw"), F.count("*").alias("seen"))
    return rows.select(key).join(sums.where(F.col("seen") == len(channels)).select(key, "raw"), key, "left")


def anchors(scores: DataFrame, raw: str = "raw") -> DataFrame:
    """center, threshold and extreme of clean scores, and how many there were; one row."""
    return quantiles(scores, [], raw, ANCHORS)


def with_evidence(scores: DataFrame, marks: Row | None, raw: str = "raw") -> DataFrame:
    """Scores as evidence between 0 and 1 by the one row of ``anchors``, which stand beside it; null without anchors."""
    if marks is None:
        return scores.withColumns({n: F.lit(None).cast("double") for n in ("evidence", *ANCHORS)})
    threshold = max(marks["threshold"], marks["center"] + 1e-9)
    found = _held(evidence(F.col(raw), marks["center"], threshold, max(marks["extreme"], threshold + 1e-9)))
    return scores.withColumns({"evidence": found} | {n: F.lit(marks[n]) for n in ANCHORS})


def _held(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
