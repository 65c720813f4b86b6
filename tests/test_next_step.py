"""Next step scores against the same rule in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairvane.operators.next_step import CALIBRATION_FACTOR, next_step_scores


def rows(seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for station in range(5):
        level = rng.normal(20, 3)
        for i in range(60):
            level += rng.normal(0, 0.4)
            t = None if rng.random() < 0.05 else float("nan") if rng.random() < 0.05 else level + (8.0 if i == 50 else 0.0)
            out.append((station, i, t, 50 + rng.normal()))
    return out


def plain(data, history, order, calibrates):
    whole = {}
    for s, i, t, h in sorted(data):
        if t is not None and t == t:
            whole.setdefault(s, []).append((i, (t, h)))
    want, sizes = {}, []
    for k in range(2):
        x, y = [], []
        for seen in whole.values():
            v = [r[1][k] for r in seen]
            for j in range(order, len(v)):
                x.append([1.0, *[v[j - m] for m in range(1, order + 1)]])
                y.append(v[j])
        x, y = np.array(x), np.array(y)
        w = np.linalg.solve(x.T @ x + np.eye(order + 1), x.T @ y)
        size = {}
        for s, seen in whole.items():
            v = [r[1][k] for r in seen]
            for j in range(history, len(v)):
                size[s, seen[j][0]] = abs(v[j] - w @ [1.0, *[v[j - m] for m in range(1, order + 1)]])
        limit = np.percentile([x for key, x in size.items() if calibrates(key)], 99)
        sizes.append({key: min(1.0, x / limit / CALIBRATION_FACTOR) for key, x in size.items()})
    for key in sizes[0]:
        want[key] = max(s[key] for s in sizes)
    return want


@pytest.mark.parametrize("order", [1, 3])
def test_scores_equal_plain(spark, order):
    data = rows()
    df = spark.createDataFrame(data, "s int, i int, t double, h double").withColumn("label", F.lit("x")).repartition(4)
    out = next_step_scores(df, "s", ["i"], ["t", "h"], history=8, order=order, calibrating=F.col("i") < 45).collect()
    got = {(r.s, r.i): r for r in out}
    assert len(out) == len(data) and {r.label for r in out} == {"x"}
    want = plain(data, 8, order, lambda key: key[1] < 45)
    for s, i, t, _ in data:
        r = got[s, i]
        if t is None or t != t:
            assert (r.skip_reason, r.next_step_score, r.h_residual) == ("current_observation_incomplete", None, None)
        elif (s, i) not in want:
            assert (r.skip_reason, r.next_step_score) == ("insufficient_valid_history", None)
        else:
            assert r.skip_reason is None and r.next_step_score == pytest.approx(want[s, i], abs=1e-6)
    assert any(r.next_step_score == 1.0 for r in out if r.i == 50)


def test_flat_channels_and_nothing(spark):
    flat = spark.createDataFrame([(1, i, 0.0) for i in range(6)], "s int, i int, t double")
    out = next_step_scores(flat, "s", ["i"], ["t"], history=2, order=1).collect()
    assert [r.next_step_score for r in sorted(out, key=lambda r: r.i)] == [None, None, 0.0, 0.0, 0.0, 0.0]
    assert next_step_scores(flat.limit(0), "s", ["i"], ["t"], history=2, order=1).count() == 0
    with pytest.raises(ValueError):
        next_step_scores(flat, "s", ["i"], ["t"], history=2, order=3)
