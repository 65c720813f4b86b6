"""Neighbours, clusters and quantiles against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairvane.functions.physics import distance_km
from fairvane.operators import cells as C
from fairvane.operators import quantiles as Q
from fairvane.operators import spatial as S

POINTS = "id long, lat double, lon double, source string, at long"


def scattered(seed, n=220):
    """Points at both poles, along the date line, in a crowd, in one place, and far apart."""
    r = random.Random(seed)
    out = [(89.5 + r.random() / 2, r.uniform(-180, 180)) for _ in range(n // 6)]
    out += [(-90 + r.random(), r.uniform(-180, 180)) for _ in range(n // 6)]
    out += [(r.uniform(-4, 4), (178 + r.random() * 4 + 180) % 360 - 180) for _ in range(n // 6)]
    out += [(20 + r.gauss(0, 0.01), 77 + r.gauss(0, 0.01)) for _ in range(n // 4)]
    out += [(20.0, 77.5)] * 30 + [(0.0, 180.0), (0.0, -180.0), (90.0, 0.0), (90.0, 120.0)]
    out += [(r.uniform(-80, 80), r.uniform(-180, 180)) for _ in range(n - len(out))]
    return [(i, lat, lon, "ab"[i % 2], r.randrange(0, 4000)) for i, (lat, lon) in enumerate(out)]


def nearest_by_force(rows, k, radius, same=False, tolerance=None):
    out = {}
    for a in rows:
        near = []
        for b in rows:
            if a[0] == b[0] or (same and a[3] != b[3]) or (tolerance is not None and abs(a[4] - b[4]) > tolerance):
                continue
            d = distance_km(*a[1:3], *b[1:3])
            if d <= radius:
                near.append((round(d, 3), b[0]))
        out[a[0]] = sorted(near)[:k]
    return out


def told(df):
    out = defaultdict(list)
    for r in df.orderBy("id", "rank").collect():
        out[r.id].append((r.distance, r.neighbour))
    return out


@pytest.mark.parametrize("seed, radius, k", [(1, 250.0, 8), (3, 2500.0, 5)])
def test_nearest_equals_brute_force(spark, seed, radius, k):
    rows = scattered(seed)
    df = spark.createDataFrame(rows + [(9998, None, 3.0, "a", 1), (9999, 95.0, 3.0, "a", 1)], POINTS)
    plain, want = told(C.nearest(df, k, radius)), nearest_by_force(rows, k, radius)
    timed = told(C.nearest(df, k, radius, ("source",), "at", 600))
    want_timed = nearest_by_force(rows, k, radius, True, 600)
    for i in want:
        assert [d for d, _ in plain[i]] == pytest.approx([d for d, _ in want[i]], abs=2e-3)
        assert [d for d, _ in timed[i]] == pytest.approx([d for d, _ in want_timed[i]], abs=2e-3)
    same_ids = sum([n for _, n in plain[i]] == [n for _, n in want[i]] for i in want)
    assert same_ids > 0.98 * len(want)  # distances on a rounding tie may be told apart otherwise
    assert {9998, 9999}.isdisjoint(plain)


def test_nearest_without_a_radius(spark):
    rows = scattered(4, 150)
    got = told(C.nearest_anywhere(spark.createDataFrame(rows, POINTS), 2))
    want = nearest_by_force(rows, 2, math.inf)
    for i in want:
        assert [d for d, _ in got[i]] == pytest.approx([d for d, _ in want[i]], abs=2e-3)


def test_a_crowd_beside_sparse_points_is_split(spark):
    """A lone point near a crowd finds its nearest; the crowd in one place does not meet in pairs."""
    rows = [(i, 10.0 + (i % 40) * 1e-4, 50.0 + (i // 40) * 1e-4, "a", 0) for i in range(1600)]
    rows += [(5000 + i, 11.0 + i / 10, 51.0, "a", 0) for i in range(5)] + [(6000 + i, 12.0, 50.0, "a", 0) for i in range(400)]
    got = told(C.nearest(spark.createDataFrame(rows, POINTS), 3, 250.0))
    some = rows[:1600:97] + rows[1600:1605] + rows[1605::57]
    for a in some:
        near = sorted((round(distance_km(*a[1:3], *b[1:3]), 3), b[0]) for b in rows if b[0] != a[0])[:3]
        assert [d for d, _ in got[a[0]]] == pytest.approx([d for d, _ in near], abs=2e-3)


def groups_by_force(rows, eps):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if distance_km(*a[1:3], *b[1:3]) <= eps:
                parent[max(find(a[0]), find(b[0]))] = min(find(a[0]), find(b[0]))
                linked |= {a[0], b[0]}
    return {i: find(i) for i in linked}


@pytest.mark.parametrize("seed, eps", [(5, 125.0), (7, 700.0)])
def test_clusters_equal_brute_force(spark, seed, eps):
    rows = scattered(seed)
    got = {r.id: r.cluster for r in S.clusters(spark.createDataFrame(rows, POINTS), eps).collect()}
    assert got == groups_by_force(rows, eps)


def test_long_chains_in_any_order(spark):
    """One chain of 600 points and a broken one, with shuffled ids: as many rounds as needed, no overflow of estimates."""
    r = random.Random(1)
    ids = r.sample(range(10_000), 700)
    rows = [(ids[i], -60 + i * 0.15, 10.0, "a", 0) for i in range(600)]
    rows += [(ids[600 + i], -60 + i * 0.15 + (5 if i > 50 else 0), 60.0, "a", 0) for i in range(100)]
    got = {x.id: x.cluster for x in S.clusters(spark.createDataFrame(rows, POINTS), 20.0).collect()}
    sizes = Counter(got.values())
    assert sorted(sizes.values()) == [49, 51, 600]
    assert all(min(i for i in got if got[i] == c) == c for c in sizes)


def test_no_points(spark):
    none = spark.createDataFrame([], POINTS)
    assert C.nearest(none, 3, 250.0).count() == 0
    assert S.clusters(none, 20.0).count() == 0


@pytest.mark.parametrize("small, bins", [(10_000, 1024), (30, 256)])
def test_quantiles_equal_numpy(spark, small, bins):
    r = np.random.default_rng(3)
    groups = {
        "even": r.uniform(-5, 5, 500), "wide": np.exp(r.normal(0, 60, 400)) * r.choice([-1, 1], 400), "ties": r.integers(0, 4, 300).astype(float),
        "one": np.array([2.5]), "same": np.full(200, 7.0), "ends": np.array([-math.inf] * 40 + [1.0] * 50 + [math.inf] * 31), None: r.normal(0, 1e-12, 250) + 1000,
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("even", float("nan")), ("none", None)]
    qs = {"low": 0.0, "q05": 0.05, "q25": 0.25, "median": 0.5, "p99": 0.99, "high": 1.0}
    got = {x.g: x for x in Q.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", qs, small, bins).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        for name, q in qs.items():
            assert got[g][name] == pytest.approx(float(np.sort(vs)[round(q * (len(vs) - 1))]) if g == "ends" else np.quantile(vs, q), rel=1e-9, abs=1e-15)


def test_medians_of_several_columns(spark):
    rows = [("a", 1.0, None), ("a", 3.0, None), ("b", 5.0, 2.0), (None, 4.0, 8.0)]
    got = {r.g: (r.x_m, r.y_m) for r in Q.medians(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], ["x", "y"], "_m").collect()}
    assert got == {"a": (2.0, None), "b": (5.0, 2.0), None: (4.0, 8.0)}
    whole = Q.quantiles(spark.createDataFrame(rows, "g string, x double, y double"), [], "x", {"m": F.least(F.lit(1.0), F.col("n") / 8)}).first()
    assert (whole.n, whole.m) == (4, 3.5)
