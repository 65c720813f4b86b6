"""Keyed machines: goldens, and streams in micro-batches equal to folds over tables."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fairvane.operators import normalise as N
from fairvane.sources import push
from fairvane.streaming import channel_drift as CD
from fairvane.streaming import event_registry as ER
from fairvane.streaming import job
from fairvane.streaming import stations as M

T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)
MACHINE = (
    "station_id long, received timestamp, row_id long, kind string, observation_id string, observed_us long, "
    "source string, status string, diagnosed boolean, action string, cadence_s double"
)


def machine_rows(n=240, stations=5, seed=1):
    """Readings and actions in order of arrival, some late, some twice, with gaps of silence."""
    r, out, at = random.Random(seed), [], T0
    for i in range(n):
        at += timedelta(seconds=r.choice([5, 20, 60, 400]))
        s = r.randrange(stations)
        us = int((at - timedelta(seconds=r.choice([0, 0, 0, 3000]))).timestamp() * 1e6)
        if r.random() < 0.2:
            out.append((s, at, i, "action", None, None, None, None, None, r.choice(["ACKNOWLEDGED", "INVESTIGATING", "RESOLVED", "DISMISSED"]), None))
        else:
            again = [x for x in out if x[0] == s and x[3] == "reading"] if r.random() < 0.1 else []
            name, us = (again[-1][4], again[-1][5]) if again else (f"o{i}", us)
            out.append((s, at, i, "reading", name, us, r.choice(["A", "A", "A", "B"]), r.choice(["NORMAL", "WARNING", "WARNING", "ANOMALY"]), r.random() < 0.7, None, 120.0))
    return out


def streamed(spark, tmp_path, chunks, schema, made):
    """Rows of a stream that gets one chunk in each micro-batch."""
    feed, sink = str(tmp_path / "feed"), str(tmp_path / "sink")
    query = None
    spark.createDataFrame([], schema).write.parquet(feed)
    out = made(spark.readStream.schema(schema).parquet(feed))
    for chunk in chunks:
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(feed)
        query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(sink)


def test_machine_stream_equals_fold(spark, tmp_path):
    rows = machine_rows()
    r = random.Random(2)
    cuts = sorted(r.sample(range(1, len(rows)), 2))
    chunks = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    for x in chunks:
        r.shuffle(x)  # rows of a micro-batch come in any order
    end = rows[-1][1] + timedelta(hours=2)
    chunks.append([(99, end, 10_000, "action", None, None, None, None, None, "RESOLVED", None)])  # another station moves the clock on
    got = streamed(spark, tmp_path, chunks, MACHINE, M.machine_stream)
    until = int((end - timedelta(minutes=1)).timestamp() * 1000)
    want = M.machine_batch(spark.createDataFrame(rows, MACHINE), until)
    key = lambda df: sorted(map(str, df.where("station_id <> 99").collect()))
    assert key(got) == key(want)
    events = {x.event for x in want.collect()}
    assert {"STATION_STALE", "OUTAGE_OPENED", "TELEMETRY_RESTORED", "LATE", "DUPLICATE", "INCIDENT_CREATED", "ACTION_REJECTED"} <= events
    last = {s: max(x[1] for x in rows if x[0] == s and x[3] == "reading") for s in range(5)}
    silent = got.where("event = 'OUTAGE_OPENED'").groupBy("station_id").agg(F.max("at_ms").alias("at")).collect()
    assert all(x.at == int(last[x.station_id].timestamp() * 1000) + 5 * 120_000 + 1 for x in silent)  # said without a further row


def said(machine):
    return [(e[2], e[4], e[9]) for e in machine.out]


def test_machine_goldens():
    m = M.Machine(1)
    read = lambda at, status, diagnosed=True, us=None, known=False: m.row(at, "reading", f"o{at}", us or at, "A", status, diagnosed, None, 60.0, known)
    read(1_000, "WARNING")
    assert said(m) == [("STATION_UPDATED", "nominal", None)] and m.out[0][5]  # a lone warning is watched
    m.out = []
    read(2_000, "WARNING")
    assert said(m) == [("STATION_UPDATED", "suspect", None), ("ANOMALY_DETECTED", "suspect", None)]
    m.out = []
    read(3_000, "WARNING")
    assert ("INCIDENT_CREATED", "suspect", "NEW") in said(m)
    m.row(3_500, "action", None, None, None, None, None, "RESOLVED", 0.0, False)
    assert m.out[-1][2] == "ACTION_REJECTED"  # a new incident can't be resolved at once
    m.row(3_600, "action", None, None, None, None, None, "INVESTIGATING", 0.0, False)
    m.row(3_700, "action", None, None, None, None, None, "RESOLVED", 0.0, False)
    assert m.incident == "RESOLVED"
    read(4_000, "NORMAL", us=2_500)
    assert m.out[-1][2] == "LATE"
    read(5_000, "NORMAL", us=3_000)
    assert m.out[-1][2] == "LATE"  # the same time is late too
    read(6_000, "ANOMALY")
    assert (m.no, m.incident) == (2, "NEW")
    m.out = []
    m.silent_until(6_000 + 3 * 60_000)
    assert m.out == []
    m.silent_until(6_000 + 6 * 60_000)
    assert [e[:3] for e in m.out] == [(1, 186_001, "STATION_STALE"), (1, 306_001, "OUTAGE_OPENED")]


def test_no_row_is_lost_to_age(spark, tmp_path):
    """Three micro-batches: a row twelve hours behind is kept, and what comes again is not."""
    day = datetime(2024, 1, 2)
    row = lambda s, hours: (s, "A", day + timedelta(hours=hours))
    batches = [[row(1, 20), row(2, 20)], [row(1, 21), row(1, 20)], [row(1, 8), row(3, 2), row(2, 20), row(1, 8)]]
    schema, feed, sink = "station_id long, source string, observed_at timestamp", str(tmp_path / "feed"), str(tmp_path / "sink")
    spark.createDataFrame([], schema).write.parquet(feed)
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = job.deduplicated(spark.readStream.schema(schema).parquet(feed))
        job.run_available(spark, stream, sink, str(tmp_path / "progress"), key="observation_id", day="observed_at")
    got = spark.read.parquet(sink)
    assert sorted((r.station_id, r.observed_at) for r in got.collect()) == sorted({(s, t) for b in batches for s, _, t in b})
    batch = spark.createDataFrame(batches[2], schema).withColumn("observation_id", N.observation_id(F.col("station_id").cast("string"), F.col("source"), F.col("observed_at")))
    job.append_once(batch, sink, "observation_id", "observed_at")  # a retry adds nothing
    assert spark.read.parquet(sink).count() == got.count() == 5


def cluster(number, members, lat, lon, magnitude=4.0, channels=("temperature",), extent=50.0):
    return {"at_us": 0, "cluster": number, "members": list(members), "lat": lat, "lon": lon, "channels": list(channels), "magnitude": magnitude, "extent_km": extent}


def fed(*snapshots, step=10):
    registry = ER.Registry("n")
    out = []
    for i, clusters in enumerate(snapshots):
        out = [dict(zip(ER._NAMES, r)) for r in registry.update(int(i * step * 60e6), clusters)]
    return {r["event"]: r for r in out}


def test_registry_goldens():
    assert fed([]) == {}
    new = fed([], [cluster(0, "ABCD", 20.0, 77.0)])["EVENT_0001"]
    assert (new["status"], new["flags"], new["member_change"]) == ("ACTIVE", "NEW", None)
    same = fed([cluster(0, "ABC", 20.0, 77.0)], [cluster(0, "ABC", 20.0, 77.0)])["EVENT_0001"]
    assert (same["flags"], same["member_change"], same["overlap"]) == ("PERSISTING", 0, 1.0)
    assert fed([cluster(0, "ABC", 20.0, 77.0)], [cluster(0, "ABCDE", 20.0, 77.0)])["EVENT_0001"]["flags"] == "PERSISTING,GROWING"
    assert fed([cluster(0, "ABCDE", 20.0, 77.0)], [cluster(0, "ABC", 20.0, 77.0)])["EVENT_0001"]["flags"] == "PERSISTING,SHRINKING"
    moved = fed([cluster(0, "ABC", 20.0, 77.0)], [cluster(0, "BCD", 21.8, 77.0)])["EVENT_0001"]
    assert moved["flags"] == "PERSISTING,MOVING" and moved["moved_km"] == pytest.approx(200, abs=1)
    assert fed([cluster(0, "ABC", 20.0, 77.0, 4.0)], [cluster(0, "ABC", 20.0, 77.0, 5.0)])["EVENT_0001"]["flags"] == "PERSISTING,INTENSIFYING"
    assert fed([cluster(0, "ABC", 20.0, 77.0, 4.0)], [cluster(0, "ABC", 20.0, 77.0, 3.0)])["EVENT_0001"]["flags"] == "PERSISTING,WEAKENING"
    other = fed([cluster(0, "ABC", 20.0, 77.0)], [cluster(0, "XYZ", 20.0, 77.0)])  # the same place is not the same event
    assert (other["EVENT_0002"]["flags"], other["EVENT_0001"]["flags"]) == ("NEW", "NEW")
    gone = fed([cluster(0, "ABC", 20.0, 77.0)], [], step=16)["EVENT_0001"]
    assert (gone["status"], gone["cluster"]) == ("DISAPPEARED", None)
    held = fed([cluster(0, "ABC", 20.0, 77.0)], [], step=15)["EVENT_0001"]
    assert held["status"] == "ACTIVE"
    late = fed([cluster(0, "ABC", 20.0, 77.0)], [cluster(0, "ABC", 20.0, 77.0)], step=20)
    assert (late["EVENT_0001"]["status"], late["EVENT_0002"]["flags"]) == ("DISAPPEARED", "NEW")


def test_registry_does_not_guess_mergers_and_splits():
    two = [cluster(0, "AB", 20.0, 77.0), cluster(1, "CD", 21.0, 77.0)]
    merged = fed(two, [cluster(0, "ABCD", 20.5, 77.0)])
    assert [merged[f"EVENT_000{i}"]["flags"] for i in (1, 2, 3)] == ["MERGE_AMBIGUOUS", "MERGE_AMBIGUOUS", "NEW"]
    assert "EVENT_0001, EVENT_0002" in merged["EVENT_0003"]["note"]
    split = fed([cluster(0, "ABCD", 20.5, 77.0)], two)
    assert [split[f"EVENT_000{i}"]["flags"] for i in (1, 2, 3)] == ["SPLIT_AMBIGUOUS", "NEW", "NEW"]


def test_registry_stream_equals_fold(spark, tmp_path):
    schema = "network string, at_us long, cluster long, members array<long>, lat double, lon double, channels array<string>, magnitude double, extent_km double"
    r = random.Random(5)
    chunks = []
    for t in range(4):
        chunk = []
        for network in ("a", "b"):
            for n in range(r.randrange(0, 4)):
                chunk.append((network, t * 480_000_000, n, sorted(r.sample(range(12), 3)), 20.0 + n, 77.0, ["temperature"], r.choice([1.0, 3.0]), 10.0))
            chunk.append((network, t * 480_000_000, None, None, None, None, None, None, None))
        chunks.append(chunk)
    got = streamed(spark, tmp_path, chunks, schema, ER.registry_stream)
    want = ER.registry_batch(spark.createDataFrame([x for c in chunks for x in c], schema))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 10


def test_recovered_stream_equals_an_unbroken_run(spark, tmp_path):
    """Stopped and started again with the stored tail, the drift scores are those of one run."""
    r = random.Random(9)
    rows = [(s, ch, "RAW", i, 10_000_000 * i, "A" if i < 150 or s else "B", r.gauss(0, 2)) for i in range(200) for s in range(2) for ch in ("temperature", "humidity")]
    schema = "station_id long, channel string, mode string, event_id long, observed_us long, source string, residual double"
    df = spark.createDataFrame(rows, schema)
    whole = {(x.station_id, x.channel, x.event_id): (x.ema, x.up, x.down, x.score) for x in CD.channel_drift_batch(df).collect()}
    early = df.where("event_id < 120")
    stored = CD.channel_drift_batch(early)
    seeded = CD.seeds(early, stored, since_us=0)
    got = streamed(spark, tmp_path, [[x for x in rows if 110 <= x[3] < 160], [x for x in rows if x[3] >= 160]], schema, lambda s: CD.recovered_stream(s, seeded))
    scores = [x for x in got.collect() if not x.late]
    assert len(scores) == 4 * 80 and got.where("late").count() == 4 * 10  # what was seen before the stop is late
    assert all((x.ema, x.up, x.down, x.score) == whole[x.station_id, x.channel, x.event_id] for x in scores)
    assert CD.seeds(early, stored, since_us=10_000_000 * 120).count() == 0


def test_pushed_items_are_judged_one_by_one(spark):
    bodies = [
        (1, '{"observations": [{"station_id": "a", "observed_at": "2024-01-01T00:00:00Z", "temperature": 21.5, "meta": {"x": 1}}, {"station_id": "bad id", "observed_at": "2024-01-01"}, 7, null]}'),
        (2, '{"station_id": "b", "observed_at": "never"}'),
        (3, '{"station_id": "b", "observed_at": "2024-01-01 10:00:00", "pressure": "low", "adapter": "x"}'),
        (4, "no json"), (5, None), (6, '{"observations": []}'), (7, "[1, 2]"),
        (8, '{"observations": [' + ", ".join(['{"station_id": "c"}'] * (push.MOST_ITEMS + 1)) + "]}"),
    ]
    got = {(x.request, x.place): x for x in push.judged(spark.createDataFrame(bodies, "request long, body string")).collect()}
    assert {k: x.reason for k, x in got.items()} == {
        (1, 0): None, (1, 1): "BAD_STATION_ID", (1, 2): "NOT_AN_OBJECT", (1, 3): "NOT_AN_OBJECT", (2, 0): "BAD_TIME", (3, 0): "BAD_NUMBER:pressure",
        (4, 0): "NOT_JSON", (5, 0): "NOT_JSON", (7, 0): "NOT_JSON", (8, 0): "TOO_MANY_ITEMS",
    }
    assert (got[1, 0].temperature, got[1, 0].adapter, got[3, 0].adapter) == (21.5, "push", "x") and "meta" not in got[1, 0]
