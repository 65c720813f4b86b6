"""The spatial layer in one pass: neighbours once, all channels in long form, verdict by station.

The neighbour graph is stored and met once by the channels of both ends.  A reading has at most
``NEIGHBOURS`` neighbours, so what a channel needs of them is a short array, and the statistics over
it are expressions.  A channel that is missing, or has too few neighbours with a value, is
UNAVAILABLE and leaves the others as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import NEIGHBOURS, SPATIAL_STD_FLOOR, SPATIAL_Z
from ..durable import durable
from ..functions.physics import spatial_raw_score
from .spatial import _median, combined_attribution, counterfactual, neighbour_edges

#: Change with height by metre (null: none), and neighbours that a channel needs.
LAPSE = {"temperature": 0.0065, "pressure": 0.12, "humidity": None}
LEAST, MAD_SCALE = 2, 0.6745


def _long(readings: DataFrame) -> DataFrame:
    parts = [
        F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value"), F.lit(SPATIAL_STD_FLOOR[c]).alias("floor"), F.lit(lapse).cast("double").alias("lapse"))
        for c, lapse in LAPSE.items()
    ]
    return readings.select("id", "elevation", F.inline(F.array(*parts)))


def _sum(xs: str, f) -> Column:
    return F.aggregate(F.transform(xs, f), F.lit(0.0), lambda a, x: a + x)


def channel_evidence(readings: DataFrame, edges: DataFrame) -> DataFrame:
    """Consensus, scores and attribution evidence of each station and channel.

    ``readings`` has id, elevation and the channels; neighbours' values are brought to the station's
    height where both heights are known.
    """
    own = _long(readings)
    theirs = own.where("value is not null").select(F.col("id").alias("neighbour"), "channel", F.col("elevation").alias("height"), F.col("value").alias("theirs"))
    lift = F.coalesce(F.col("lapse") * (F.col("elevation") - F.col("height")), F.lit(0.0))
    estimate = F.when(F.col("channel") == "humidity", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("theirs")))).otherwise(F.col("theirs") - lift)
    weight = 1 / F.pow(F.greatest(F.col("distance"), F.lit(1.0)), 2)
    met = edges.select("id", "neighbour", "distance").join(own.hint("merge"), "id").join(theirs.hint("merge"), ["neighbour", "channel"])
    met = met.select("id", "channel", estimate.alias("x"), weight.alias("w"))
    sums = met.groupBy("id", "channel").agg(
        F.sort_array(F.collect_list(F.struct("x", "w"))).alias("near"),  # NEIGHBOURS at most
        (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"),
        F.stddev_pop("x").alias("spread"),
    )
    out = own.select("id", "channel", F.col("value").alias("own"), "floor").join(sums.hint("merge"), ["id", "channel"], "left")
    out = out.withColumn("neighbours", F.coalesce(F.size("near"), F.lit(0)))
    out = out.withColumn("neighbours", F.when(F.col("near").isNull(), 0).otherwise(F.col("neighbours")))
    fit = F.col("own").isNotNull() & (F.col("neighbours") >= LEAST)
    out = out.withColumn("state", F.when(fit, "EVALUATED").otherwise("UNAVAILABLE"))
    out = out.withColumn("median", _median(F.transform("near", lambda n: n.x)))
    out = out.withColumn("mad", _median(F.array_sort(F.transform("near", lambda n: F.abs(n.x - F.col("median"))))))
    scale = F.greatest(F.col("mad"), F.col("floor") * MAD_SCALE)
    out = out.withColumn("z", F.abs(F.col("own") - F.col("mean")) / F.greatest(F.col("spread"), F.col("floor")))
    out = out.withColumn("robust_z", MAD_SCALE * (F.col("own") - F.col("median")) / scale)
    out = out.withColumn("told", F.transform("near", lambda n: F.struct((MAD_SCALE * (n.x - F.col("median")) / scale).alias("z"), n.w.alias("w"))))
    with_us = F.filter("told", lambda n: (F.abs(n.z) >= 1) & (F.signum(n.z) == F.signum(F.col("robust_z"))))
    out = out.withColumn("support", with_us)
    n, k = F.col("neighbours"), F.size("support")
    coverage = F.least(F.lit(1.0), n / NEIGHBOURS)
    ratio = _sum("support", lambda s: F.abs(s.z)) / k / F.abs("robust_z")
    of_size = F.when((k > 0) & ratio.between(1 / 3, 3), 1.0).otherwise(0.0)
    evaluated = F.col("state") == "EVALUATED"
    regional = coverage * _sum("support", lambda s: s.w) / _sum("told", lambda s: s.w) * of_size
    out = out.withColumn("regional", F.when(evaluated, regional)).withColumn("isolated", F.when(evaluated, coverage * (1 - k / n)))
    lean = (
        F.when(~evaluated, "UNAVAILABLE")
        .when(F.abs("robust_z") <= SPATIAL_Z, "NOT_ANOMALOUS")
        .when(F.col("regional") > F.col("isolated"), "REGIONAL")
        .when(F.col("isolated") > F.col("regional"), "ISOLATED")
        .otherwise("UNCERTAIN")
    )
    return out.withColumn("score", F.when(evaluated, spatial_raw_score(F.col("z"), n))).withColumn("classification", lean).drop("near", "told", "support", "floor")


def evaluated(readings: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row for each station: score of the worst channel, its channels' states, attribution and counterfactual.

    A station without any channel to compare is INSUFFICIENT_NEIGHBOURS, with no score.
    """
    edges = durable(neighbour_edges(readings.select("id", "lat", "lon", "source", "observed_at"))) if edges is None else edges
    channels = durable(channel_evidence(readings, edges))
    far = F.col("classification").isin("REGIONAL", "ISOLATED", "UNCERTAIN")
    stations = channels.groupBy("id").agg(
        F.max("score").alias("score"),
        F.max("neighbours").alias("neighbours"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "channel", "classification"))), ",").alias("channels"),
        F.coalesce(F.avg(F.when(far, F.col("regional"))), F.lit(0.0)).alias("regional"),
        F.coalesce(F.avg(F.when(far, F.col("isolated"))), F.lit(0.0)).alias("isolated"),
    )
    leans = combined_attribution(channels.select("id", "classification", F.greatest("regional", "isolated").alias("strength")))
    out = stations.join(leans.select("id", "attribution").hint("merge"), "id")
    seen = F.col("score").isNotNull()
    return out.select(
        "id",
        F.when(seen, "EVALUATED").otherwise("INSUFFICIENT_NEIGHBOURS").alias("state"),
        "neighbours",
        "score",
        "channels",
        "regional",
        "isolated",
        F.when(seen, F.col("attribution")).otherwise("UNCERTAIN").alias("attribution"),
        F.when(seen, counterfactual(F.col("regional"), F.col("isolated"))).otherwise("CONTRADICTED").alias("counterfactual"),
    )
