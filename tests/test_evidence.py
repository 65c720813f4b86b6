"""Shown evidence, calibration and made-up readings on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from fairvane.operators import calibration as K
from fairvane.operators import evidence as V
from fairvane.operators import synthetic as Y


def test_layer_state(spark):
    cases = [
        (None, True, "UNAVAILABLE"), ("pass", None, "PASS"), ("PASS", False, "INSUFFICIENT"), ("VETO", True, "ANOMALY"),
        ("LIMITED", True, "INSUFFICIENT"), ("NOT_APPLICABLE", False, "NOT_APPLICABLE"), ("odd", True, "UNAVAILABLE"), (None, False, "UNAVAILABLE"),
    ]
    rows = spark.createDataFrame(cases, "status string, available boolean, expected string")
    got = rows.select("expected", V.layer_state(F.col("status"), F.col("available")).alias("state")).collect()
    assert all(r.state == r.expected for r in got)


def test_display_status(spark):
    def shown(a, b, backend, diagnosis, in_situ):
        states = {"Physics": F.lit(a), "Temporal": F.lit(b)}
        one = V.display_status(states, F.lit(backend).cast("string"), F.lit(diagnosis).cast("string"), F.lit(in_situ).cast("boolean"))
        return spark.range(1).select(one.alias("s")).first().s

    assert shown("PASS", "PASS", "NORMAL", None, True).status == "NORMAL"
    assert shown("PASS", "PASS", "NORMAL", None, None).label == "NO ANOMALY CONFIRMED"
    part = shown("PASS", "INSUFFICIENT", None, None, True)
    assert part.status == "NO_ANOMALY_CONFIRMED"
    assert part.detail == "Assessed by 1 of 2 layers (Physics). Not assessed: Temporal."
    none = shown("UNAVAILABLE", "INSUFFICIENT", "NORMAL", None, True)
    assert none.status == "INSUFFICIENT_EVIDENCE" and none.detail.startswith("Assessed by 0 of 2 layers. Not")
    assert shown("PASS", "PASS", "NORMAL", "INSUFFICIENT_EVIDENCE", True).status == "INSUFFICIENT_EVIDENCE"
    assert shown("UNAVAILABLE", "UNAVAILABLE", "offline", None, False).status == "OFFLINE"


RECORDS = "kind string, id long, is_anomaly boolean, rules_score double, model_score double, model_peak double, integrated_score double"


def test_contribution_classes(spark):
    rows = [
        ("both", 1, True, 0.9, 0.8, 0.8, 0.9), ("both", 1, False, 0.1, 0.2, 0.2, 0.2),
        ("model", 2, True, 0.1, 0.8, 0.9, 0.8), ("model", 3, True, 0.3, 0.9, 0.9, 0.9),
        ("rules", 4, True, 0.9, None, None, 0.9), ("quiet", 5, False, 0.0, None, None, 0.0),
    ]
    got = {r.kind: r for r in K.contributions(spark.createDataFrame(rows, RECORDS), "kind", "id").collect()}
    assert {k: r["class"] for k, r in got.items()} == {"both": "B", "model": "A", "rules": "C", "quiet": None}
    assert got["model"].rules == 0.2 and got["model"].cases == 2 and got["both"].rules_normal == 0.1
    sweep = {r.threshold: r for r in K.threshold_sweep(spark.createDataFrame(rows, RECORDS)).collect()}
    assert sweep[0.75].anomalous_pct == 75.0 and sweep[0.25].normal_pct == 0.0


def test_empty_tables(spark):
    none = spark.createDataFrame([], RECORDS)
    assert K.contributions(none, "kind", "id").count() == 0
    assert [r.anomalous_pct for r in K.threshold_sweep(none).collect()] == [None] * len(K.SWEEP)
    assert K.acceptance(none, "kind", "rules_score", ["rules_score", "model_score"]).count() == 0


def test_acceptance(spark):
    rows = [("near", 0.1 * i, 1.0) for i in range(-10, 11)] + [("far", 7.0, 0.0)] * 3 + [("none", None, None)]
    z = spark.createDataFrame(rows, "source string, zp double, zt double")
    got = {r.source: r for r in K.acceptance(z, "source", "zp", ["zp", "zt"]).collect()}
    assert got["near"].accepted and got["near"].median_zp == 0.0
    assert not got["far"].c1 and got["far"].far_share == 1.0
    assert not got["none"].accepted and got["none"].far_share == 0.0


def test_autoregressive_follows_the_recursion(spark):
    rows = [(k, t, 0.5 if t else 0.0, float(k + t)) for k in (1, 2, 3) for t in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        table = spark.createDataFrame(rows, "k long, t int, carry double, e double").repartition(5)
        got = {(r.k, r.t): r.v for r in Y.autoregressive(table, ["k"], "t", "carry", "e", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in (1, 2, 3):
        v = 0.0
        for t in range(50):
            v = 0.5 * v + (k + t) if t else float(k)
            assert math.isclose(got[k, t], v)


def test_noise_is_repeatable_and_normal(spark):
    rows = spark.range(20000).select(Y.normal(F.col("id"), "x").alias("x"), Y.uniform(F.col("id"), "x").alias("u"))
    a = rows.agg(F.avg("x"), F.stddev("x"), F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(a[0]) < 0.03 and abs(a[1] - 1) < 0.03 and abs(a[2] - 0.5) < 0.01 and a[3] > 0 and a[4] < 1
    again = spark.range(20000).repartition(7).select(Y.normal(F.col("id"), "x").alias("x"))
    assert rows.select("x").exceptAll(again).count() == 0


def test_near_stations_see_the_same_weather(spark):
    rows = [(i, 20.0 + 0.01 * i, 78.0, 28.0, 20.0, 1009.0, 8.0) for i in range(4)]
    known = spark.createDataFrame(rows, "id long, lat double, lon double, t_mean double, td_mean double, p_base double, wind_mean double")
    out = Y.synthetic_network(known, 36).toPandas()
    assert len(out) == 4 * 36 and out.notna().all().all()
    wide = out.pivot(index="tick", columns="id", values="pressure")
    moved = wide.sub(wide.mean())
    assert moved.sub(moved[0], axis=0).abs().max().max() < 0.3  # only sensor noise and steps differ
    assert out.humidity.between(0, 100).all() and (out.wind_speed >= 0).all()


def test_network_spreads_stations_over_ticks_last(spark):
    """Gusts follow their recursion within a station's row, and no reading passes a shuffle, sort or Python."""
    noises = [[1.0, -2.0, 0.5, 3.0], [0.0, 1.0, 0.0, 0.0]]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(noises)], "id long, x array<double>").unionByName(spark.createDataFrame([], "id long, x array<double>"))
    for r in Y.carried(table, "x", 0.85).collect():
        want, value = [], 0.0
        for x in noises[r.id]:
            value = 0.85 * value + x
            want.append(value)
        assert r.x == pytest.approx(want, abs=1e-12)
    known = spark.range(50).selectExpr("id", "1D + id AS lat", "2D AS lon", "20D AS t_mean", "12D AS td_mean", "1000D AS p_base", "8D AS wind_mean")
    out = Y.synthetic_network(known, 24)
    assert out.count() == 50 * 24
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    readings = plan[: plan.index("Generate posexplode")].split("Join")[0]
    assert plan.count("MapInPandas") == 1 and not any(x in readings for x in ("Repartition", "Sort", "MapIn"))
