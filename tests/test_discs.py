"""Discs against all pairs, and queries that must not list or broadcast what they count."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fairvane.functions.physics import distance_km
from fairvane.operators import discs, spatial

SF = "/root/testdata/sf0.001"


def scattered(n: int = 300) -> list[tuple]:
    """Points in a crowd, at the poles, at the date line, on top of each other and anywhere."""
    r = random.Random(7)
    rows = []
    for i in range(n):
        kind = i % 5
        lat, lon = r.uniform(-90, 90), r.uniform(-180, 180)
        if kind == 0:
            lat, lon = 48 + r.random(), 11 + r.random()
        elif kind == 1:
            lat, lon = r.choice([-1, 1]) * r.uniform(88.5, 90), r.uniform(-180, 180)
        elif kind == 2:
            lat, lon = r.uniform(-1, 1), r.choice([179.5, 180.0, -180.0, -179.7])
        elif kind == 3:
            lat, lon = 48.5, 11.5
        rows.append((i, float(lat), float(lon), "ab"[i % 3 == 0], r.randrange(60), None if i % 11 == 0 else r.randrange(50) / 4))
    return rows


@pytest.mark.parametrize("radius, asked", [(120.0, 300_000), (40.0, 70), (9000.0, 300_000)])
def test_counts_equal_all_pairs(spark, monkeypatch, radius, asked):
    monkeypatch.setattr(discs, "ASKING", 40)
    monkeypatch.setattr(discs.met, "__defaults__", (asked,))
    rows = scattered()
    points = spark.createDataFrame(rows, "id long, lat double, lon double, source string, at long, v double")
    ours = {r["id"]: r["others"] for r in spatial.others_within(points, radius).collect()}
    near = lambda a, b: distance_km(a[1], a[2], b[1], b[2]) <= radius
    assert ours == {a[0]: sum(near(a, b) for b in rows) - 1 for a in rows}
    timed = discs.counts(points, radius, ("source",), "at", 10)
    pairs = sum(near(a, b) and a[3] == b[3] and abs(a[4] - b[4]) <= 10 for a in rows for b in rows)
    assert timed.agg(F.sum(F.col("n") * F.col("near"))).first()[0] == pairs


def test_order_statistics_equal_sorted_neighbours(spark):
    rows = scattered()
    points = spark.createDataFrame(rows, "id long, lat double, lon double, source string, at long, v double")
    ours = {r["id"]: (r["n"], r["low"], r["median"], r["high"]) for r in discs.order_statistics(points, "v", 150.0).collect()}
    for a in rows:
        v = sorted(b[5] for b in rows if b is not a and b[5] is not None and distance_km(a[1], a[2], b[1], b[2]) <= 150.0)
        assert ours[a[0]] == ((len(v), v[0], v[len(v) // 2], v[-1]) if v else (0, None, None, None))


def test_exclusions_equal_all_pairs_with_repeated_ids_and_nulls(spark):
    rows = [(i // 2 if i % 7 == 0 else i, a, b, None if i % 13 == 0 else s, None if i % 17 == 0 else t) for i, a, b, s, t, _ in scattered(200)]
    points = spark.createDataFrame(rows, "id long, lat double, lon double, source string, at long")
    points = points.withColumn("observed_at", F.timestamp_seconds(F.col("at") * 60)).drop("at")
    ours = spatial.exclusion_counts(points, 120.0, 10.0).first().asDict()
    told = Counter()
    for a in rows:
        for b in rows:
            if distance_km(a[1], a[2], b[1], b[2]) > 120.0:
                continue
            if a[0] == b[0]:
                told["self"] += 1
            elif None in (a[3], b[3]):
                continue
            elif a[3] != b[3]:
                told["source_mismatch"] += 1
            elif None not in (a[4], b[4]):
                told["kept" if abs(a[4] - b[4]) <= 10 else "time_mismatch"] += 1
    assert ours == dict(told)


@pytest.mark.parametrize("name", ["EXT18_densest_group", "MDL21_spatial_verdict", "SRT01_nearest_three", "AGG24_neighbour_counts", "JN02_pool_neighbours", "EXT16_replay_neighbours", "SRT04_densest", "JN01_exclusions"])
def test_no_list_of_all_pairs(spark, monkeypatch, name):
    def refused(*_):
        raise AssertionError("all pairs within the radius")

    monkeypatch.setattr(spatial, "pairs_within", refused)
    assert entry.queries()[name](spark, SF).columns


@pytest.mark.parametrize("name", ["JN01_neighbours", "AGG05_AGG06_consensus", "MDL09_attribution", "MDL12_spatial_layer", "SRT08_map_lines", "ST07_snapshot_scoring"])
def test_stations_are_not_broadcast(spark, name):
    assert "Broadcast" not in entry.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
