"""How rules and a model share the work: contribution classes, threshold sweep, acceptance of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from .quantiles import medians, quantiles

#: A strong score, thresholds of the sweep, and the limits of the three acceptance checks.
STRONG = 0.7
SWEEP = (0.25, 0.40, 0.50, 0.60, 0.75)
MEDIAN_RANGE, P95_LIMIT, FAR_Z, FAR_SHARE = (-2.0, 2.0), 5.0, 6.0, 0.05


def contributions(records: DataFrame, kind: str, case: str) -> DataFrame:
    """By kind of fault: medians of each case's highest scores, and what the model adds to the rules.

    ``records``: is_anomaly, rules_score, model_score, model_peak, integrated_score.
    Class A: the model alone is strong; B: both are; C: it adds little.  A kind without
    anomalous rows has nulls and no class.
    """
    bad, good = F.col("is_anomaly"), ~F.col("is_anomaly")
    scores = {"rules": "rules_score", "model": "model_score", "peak": "model_peak", "integrated": "integrated_score"}
    cases = records.groupBy(kind, case).agg(
        F.count_if(bad).alias("anomalous"), *[F.max(F.when(bad, F.col(s))).alias(n) for n, s in scores.items()]
    )
    cases = durable(cases)
    kinds = cases.groupBy(kind).agg(F.count("*").alias("cases"), F.sum("anomalous").alias("anomalous_rows"))
    kinds = kinds.join(medians(cases, [kind], list(scores)), kind)
    normal = records.where(good).select(kind, F.col("rules_score").alias("rules_normal"), F.col("model_score").alias("model_normal"))
    normal = medians(normal, [kind], ["rules_normal", "model_normal"])
    rules, model = F.col("rules") >= STRONG, F.coalesce(F.col("model"), F.lit(0.0)) >= STRONG
    label = F.when(F.col("rules").isNull(), None).when(rules & model, "B").when(model, "A").otherwise("C")
    return kinds.withColumn("class", label).join(normal, kind, "left")


def threshold_sweep(records: DataFrame, thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """Percent of anomalous and of normal rows whose peak is over each threshold, in one pass."""

    def share(over: float, rows: Column) -> Column:
        hit = F.coalesce(F.col("model_peak") > over, F.lit(False)).cast("double")
        return 100 * F.avg(F.when(rows, hit))

    bad = F.col("is_anomaly")
    rates = records.agg(
        F.array(
            *[
                F.struct(F.lit(x).alias("threshold"), share(x, bad).alias("anomalous_pct"), share(x, ~bad).alias("normal_pct"))
                for x in thresholds
            ]
        ).alias("r")
    )
    return rates.select(F.inline("r"))


def acceptance(features: DataFrame, key: str, pressure_z: str, all_z: list[str]) -> DataFrame:
    """By key: whether features of another source lie in the space the models were trained on.

    c1: the median pressure z lies in its range; c2: its 95th percentile is small enough;
    c3: few rows have any z far out.  ``accepted`` needs all three.
    """
    far = F.coalesce(F.greatest(*[F.abs(F.col(z)) for z in all_z]) > FAR_Z, F.lit(False)).cast("double")
    stats = features.groupBy(key).agg(F.avg(far).alias("far_share"))
    middle = quantiles(features, [key], pressure_z, {"median_zp": 0.5}).drop("n")
    wide = quantiles(features.select(key, F.abs(F.col(pressure_z)).alias("size")), [key], "size", {"p95_abs_zp": 0.95}).drop("n")
    stats = stats.join(middle, key, "left").join(wide, key, "left")
    checks = {
        "c1": F.col("median_zp").between(*MEDIAN_RANGE),
        "c2": F.col("p95_abs_zp") <= P95_LIMIT,
        "c3": F.col("far_share") <= FAR_SHARE,
    }
    checks = {n: F.coalesce(x, F.lit(False)) for n, x in checks.items()}
    return stats.withColumns(checks).withColumn("accepted", F.col("c1") & F.col("c2") & F.col("c3"))
