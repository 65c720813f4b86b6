"""Logs, retention, references as of a time, fitted tail scores and components."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairvane.operators import asof, consistency, ecod, layer4, ranges
from fairvane.operators import history as H
from fairvane.streaming import event_log as EL


def test_running_sums_over_ranges(spark):
    rows = [(g, i, i % 5) for g in ("a", "b", None) for i in range(120)]
    out = ranges.running(spark.createDataFrame(rows, "g string, i long, x long").repartition(5).where("g is not null"), ["g"], ["i"], "x")
    for r in out.collect():
        assert r.upto == sum(i % 5 for i in range(r.i + 1))


def test_log_replay_and_retry(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "at long, what string"
    batches = [[(3, "c"), (1, "a"), (2, "b")], [], [(9, "x"), (8, "w")]]
    for n, b in enumerate(batches):
        EL.append_batch(spark.createDataFrame(b, schema), n, path, ["at"])
    EL.append_batch(spark.createDataFrame(batches[2][::-1], schema), 2, path, ["at"])  # tried again
    log = [(1, "a"), (2, "b"), (3, "c"), (4, "w"), (5, "x")]
    for after in range(7):
        rows, resync = EL.replay(spark, path, after)
        assert sorted((r.id, r.what) for r in rows.collect()) == [x for x in log if x[0] > after] and not resync
    rows, resync = EL.replay(spark, path, 1, ring=2)
    assert resync and sorted(r.id for r in rows.collect()) == [4, 5]
    spark.createDataFrame([(1, "torn", 99)], "at long, what string, id long").write.parquet(f"{path}/events/batch=3")
    assert EL.replay(spark, path, 0)[0].count() == 5  # a batch without a head doesn't count yet


def test_retention_and_recovery(spark, tmp_path):
    path = str(tmp_path / "kept")
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(96)]
    df = spark.createDataFrame(rows, "id long, ts timestamp").withColumn("date", F.to_date("ts"))
    df.write.partitionBy("date").parquet(path)
    ids = lambda: sorted(r.id for r in spark.read.schema(df.schema).parquet(path).collect())
    EL.retain(spark, path, "ts", "2024-01-02 06:00:00")
    assert ids() == list(range(30, 96))
    fs, Path = EL._files(spark, path)
    fs.rename(Path(f"{path}/date=2024-01-03"), Path(f"{path}/_aside-date=2024-01-03-0"))  # killed between the two renames
    spark.range(1).write.parquet(f"{path}/_edge-0")
    EL.recover(spark, path)
    assert ids() == list(range(30, 96)) and not fs.exists(Path(f"{path}/_edge-0"))
    EL.retain(spark, path, "ts", "2024-01-04 00:00:00")
    EL.retain(spark, path, "ts", "2024-01-04 00:00:00")
    assert ids() == list(range(72, 96))


def test_reference_as_of(spark):
    r = np.random.default_rng(2)
    refs = [(int(r.integers(0, 3)), int(t), float(v)) for t, v in zip(r.integers(0, 5000, 60), r.normal(size=60))] + [(0, 100, 1.0), (0, 100, 5.0)]
    asked = [(i, int(r.integers(0, 4)), int(r.integers(0, 6000))) for i in range(200)] + [(900, 0, 100), (901, None, 100)]
    out = asof.reference_as_of(
        spark.createDataFrame(asked, "id long, p int, s long"), spark.createDataFrame(refs, "p int, s long, v double"), "id", ["p"], "s", "v", 100, 700
    )
    got = {x.id: (x.reference, x.age_s, x.state) for x in out.collect()}
    for i, p, s in asked:
        known = [(t, v) for q, t, v in refs if q == p and t <= s and s - t <= 700]
        t, v = max(known, default=(None, None))
        assert got[i] == ((v, s - t, "FRESH" if s - t <= 100 else "STALE") if known else (None, None, "MISSING"))


def test_scores_equal_the_closed_form_on_the_fit_rows(spark):
    r = np.random.default_rng(4)
    rows = [(i, float(round(a, 1)), float(b)) for i, (a, b) in enumerate(zip(r.normal(size=300), r.integers(0, 9, 300)))]
    df = spark.createDataFrame(rows + [(999, None, 1.0)], "id long, x double, y double")
    fit = ecod.fitted(df, ["x", "y"])
    got = {s.id: s.raw for s in ecod.scored(df, "id", ["x", "y"], fit).collect()}
    closed = {s.id: s.ecod for s in H.ecod(df.where("x is not null"), ["x", "y"]).collect()}
    assert got.pop(999) is None and got == pytest.approx(closed)
    new = ecod.scored(spark.createDataFrame([(1, 100.0, -5.0)], "id long, x double, y double"), "id", ["x", "y"], fit).first()
    assert new.raw == pytest.approx(2 * np.log(301))  # beyond every fitted value
    marks = ecod.anchors(ecod.scored(df, "id", ["x", "y"], fit)).first()
    assert marks.center == pytest.approx(np.quantile(list(closed.values()), 0.95))
    told = ecod.with_evidence(spark.createDataFrame([(marks.center,), (marks.threshold,), (99.0,), (None,)], "raw double"), marks)
    assert [x.evidence for x in told.collect()] == [0.0, 0.5, 1.0, None]


def test_components_equal_numpy(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(400, 2))
    x = base @ np.array([[5.0, -9.0, 8.0, 200.0], [2.0, 6.0, 1.0, -150.0]]) + r.normal(0, 0.1, (400, 4)) + np.array([24, 1010, 60, 400])
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], "temperature double, pressure double, humidity double, elevation double")
    model = consistency.fitted(df.unionByName(df.limit(1).withColumn("pressure", F.lit(None).cast("double"))))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, vectors = np.linalg.eigh(z.T @ z / len(z))
    top = vectors[:, ::-1][:, :2]
    assert abs(np.abs(np.array(model.loadings) @ top) - np.eye(2)).max() < 1e-6
    whole = consistency.scored(df, model).collect()
    assert max(row.consistency for row in whole) == 0.0
    spoiled = consistency.scored(df.withColumn("temperature", F.col("temperature") + 60), model).collect()
    assert all(0 < row.consistency <= consistency.CAP and row.worst is not None for row in spoiled)
    without = consistency.scored(df.withColumn("pressure", F.lit(None).cast("double")), model).collect()
    assert max(abs(row.temperature - row.expected_temperature) for row in without) < 1.5
    lone = consistency.scored(df.withColumn("pressure", F.lit(None).cast("double")).withColumn("humidity", F.lit(None).cast("double")), model).first()
    assert (lone.consistency, lone.worst, lone.expected_temperature) == (0.0, None, None)


def test_spatial_layer_in_one_pass(spark):
    """One station is off alone, one lacks a channel, one is far from all; each channel stands by itself."""
    at = datetime(2024, 1, 1, 12)
    rows = [(i, 20.0 + i * 0.05, 77.0, 100.0, "A", at, 25.0 + (i % 2) * 0.1, 1010.0, 60.0) for i in range(6)]
    rows[2] = (2, *rows[2][1:6], 45.0, 1010.0, 60.0)
    rows[3] = (3, *rows[3][1:8], None)
    rows += [(9, -50.0, 10.0, None, "A", at, 25.0, 1010.0, 60.0), (10, 20.1, 77.0, None, "B", at, 99.0, None, None)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, elevation double, source string, observed_at timestamp, temperature double, pressure double, humidity double")
    got = {r.id: r for r in layer4.evaluated(df).collect()}
    assert set(got) == {r[0] for r in rows}
    off = got[2]
    assert (off.state, off.neighbours, off.attribution, off.counterfactual) == ("EVALUATED", 5, "ISOLATED", "SUPPORTED_ISOLATED")
    assert off.score == 1.0 and "temperature:ISOLATED" in off.channels and "pressure:NOT_ANOMALOUS" in off.channels
    assert "humidity:UNAVAILABLE" in got[3].channels and "temperature:NOT_ANOMALOUS" in got[3].channels
    assert got[0].attribution == "UNCERTAIN" and got[0].score < 0.5  # nothing to attribute
    for i in (9, 10):  # no neighbours of its source in reach
        assert (got[i].state, got[i].score, got[i].counterfactual) == ("INSUFFICIENT_NEIGHBOURS", None, "CONTRADICTED")
