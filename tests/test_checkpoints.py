"""Case figures and data set quality against plain Python."""

import random
from datetime import datetime, timedelta
from statistics import median

import pytest

from fairvane.operators.checkpoints import case_figures, checkpoint_summary, dataset_quality


def plain_figures(rows, start, duration, threshold, checkpoints):
    rows = sorted(rows)
    end = start + duration - 1
    inside = [r for r in rows if start <= r[0] <= end]
    res = [(s, v) for s, v, _ in inside if v is not None]
    scores = [v > threshold for _, _, v in inside if v is not None]
    run = 0
    for s, v, _ in rows:
        if s < start:
            continue
        if v is not None:
            break
        run += 1
    at = dict(res)
    return {
        "onset": res[0][1] if res else None,
        "largest": max((v for _, v in res), default=None),
        "near_end": res[-1][1] if res else None,
        **{f"after_{n}": at.get(min(start + n, end)) for n in checkpoints},
        "persists": (scores[-1] if scores else False) if res else None,
        "crossed": any(scores),
        "unavailable_share": sum(v is None for _, v, _ in inside) / len(inside) if inside else None,
        "unavailable_run": run,
    }


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(3)
    held = {}
    for case in range(40):
        gone = rng.choice([0.0, 0.3, 1.0])
        steps = [] if case == 7 else rng.sample(range(60), rng.randint(1, 60))
        rows = [(s, None if rng.random() < gone else round(rng.random() * 9, 2), None if rng.random() < 0.2 else round(rng.random(), 2)) for s in steps]
        held[case] = ("frozen" if case % 2 else None, rng.randint(0, 30), rng.randint(1, 40), rows)
    return held


def frames(spark, cases):
    scored = [(k, s, v, x if x is not None else float("nan")) for k, (_, _, _, rows) in cases.items() for s, v, x in rows]
    return (
        spark.createDataFrame(scored, "case_id int, step int, residual double, score double"),
        spark.createDataFrame([(k, v[0], v[1], v[2]) for k, v in cases.items()], "case_id int, kind string, start int, duration int"),
    )


def test_case_figures_equal_plain(spark, cases):
    out = {r.case_id: r.asDict() for r in case_figures(*frames(spark, cases), 0.5, (2, 10)).collect()}
    assert set(out) == set(cases)
    for k, (kind, start, duration, rows) in cases.items():
        want = plain_figures(rows, start, duration, 0.5, (2, 10))
        assert out[k].pop("kind") == kind
        assert {n: v for n, v in out[k].items() if n != "case_id"} == pytest.approx(want), k


def test_summary_is_by_kind(spark, cases):
    out = {(r.kind, r.figure): r for r in checkpoint_summary(*frames(spark, cases), 0.5, (2, 10)).collect()}
    for kind in (None, "frozen"):
        for figure in ("onset", "unavailable_run", "persists"):
            each = [plain_figures(rows, s, d, 0.5, (2, 10))[figure] for k, s, d, rows in cases.values() if k == kind]
            each = [float(x) for x in each if x is not None]
            got = out[kind, figure]
            assert (got.n, got.median, got.largest) == (len(each), pytest.approx(median(each)), max(each))
            assert got["mean"] == pytest.approx(sum(each) / len(each))


def test_quality_counts_equal_plain(spark):
    rng, base = random.Random(5), datetime(1969, 12, 31, 20)
    rows = []
    for i in range(600):
        station = rng.choice(["a", "a", "a", "b", "c", None])
        t = None if rng.random() < 0.05 else base + timedelta(minutes=rng.choice([10, 10, 10, 7]) * rng.randint(0, 120))
        v = rng.choice([None, float("nan"), -1.0, 5.0, 11.0])
        rows.append((station, t, rng.choice([None, "train"]) if station != "c" else rng.choice(["train", "test"]), v))
    df = spark.createDataFrame(rows, "station string, t timestamp, split string, v double").repartition(5)
    out = {r.measure: r.n for r in dataset_quality(df, "station", "t", "split", {"v": (0.0, 10.0)}, 600).collect()}
    wrong = 0
    for s in "abc":
        ts = sorted(t for x, t, _, _ in rows if x == s and t is not None)
        wrong += sum(b - a != timedelta(minutes=10) for a, b in zip(ts, ts[1:]))
    assert out == {
        "rows": 600,
        "stations": 3,
        "repeated": 600 - len({(s, t) for s, t, _, _ in rows}),
        "wrong_steps": wrong,
        "split_overlap": 1,
        "missing_v": sum(v is None or v != v for *_, v in rows),
        "outlying_v": sum(v in (-1.0, 11.0) for *_, v in rows),
    }


def test_quality_of_nothing(spark):
    df = spark.createDataFrame([], "station string, t timestamp, split string, v double")
    out = {r.measure: r.n for r in dataset_quality(df, "station", "t", "split", {"v": (0.0, 10.0)}, 600).collect()}
    assert set(out.values()) == {0} and len(out) == 7
