"""Queries for keyed state, recovery, snapshots, estimation and recounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import shared_path
from ..operators import estimation as E
from ..operators import readmodel as R
from ..operators import spatial as S
from ..streaming import channel_drift as CD
from ..streaming import job
from .network_queries import _CONS, EDGES, edges_of
from .registry import query
from .stand_ins import OBSERVATIONS_SQL as OBS
from .stand_ins import STATIONS_SQL as ST
from .stand_ins import observations, stations, table

c = F.col


@query("ST02_deduplication", "SELECT DISTINCT user_id AS station_id, event_type AS source, ts AS observed_at FROM events")
def q_deduplication(spark, sf):
    """A stream of three files, newest days first and every third event twice, into a sink that holds each observation once."""
    events = observations(spark, sf).select("event_id", "station_id", "source", c("observed_at").cast("timestamp").alias("observed_at"))
    feed, sink = shared_path(spark, "feed"), shared_path(spark, "sink")
    for days in ("day(observed_at) > 20", "day(observed_at) BETWEEN 11 AND 20 OR event_id % 3 = 0", "day(observed_at) <= 10"):
        events.where(days).coalesce(1).write.mode("append").parquet(feed)
    stream = job.deduplicated(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(feed))
    job.run_available(spark, stream, sink, shared_path(spark, "progress"), key="observation_id", day="observed_at")
    return spark.read.parquet(sink).select("station_id", "source", c("observed_at").cast("timestamp_ntz").alias("observed_at"))


_CLASS = "CASE WHEN day(observed_at) > 15 THEN 'SIMULATED' ELSE 'MEASURED' END"
_AGREED = "CASE WHEN event_id % 4 > 0 THEN value + CAST(event_id % 9 - 4 AS DOUBLE) / 2 END"
_GROUND = "CASE WHEN event_id % 3 > 0 THEN value - CAST(event_id % 7 AS DOUBLE) / 2 END"
_CHANNELS = ("temperature", "pressure", "humidity")


@query(
    "ST05_ST06_channel_drift",
    f"""WITH RECURSIVE {OBS}, l AS ({' UNION ALL '.join(f"SELECT station_id, event_id, observed_at, '{x}' AS channel, {x} AS value FROM obs WHERE {x} IS NOT NULL" for x in _CHANNELS)}),
a AS (SELECT *, {_CLASS} AS class, {_AGREED} AS agreed, {_GROUND} AS ground FROM l),
m AS (SELECT *, CASE WHEN agreed IS NOT NULL THEN 'SPATIAL' WHEN ground IS NOT NULL THEN 'BACKGROUND' ELSE 'RAW' END AS mode, value - coalesce(agreed, ground, 0.0) AS r,
CASE channel WHEN 'temperature' THEN 1.0::DOUBLE WHEN 'pressure' THEN 1.25::DOUBLE ELSE 2.5::DOUBLE END AS k, CASE channel WHEN 'temperature' THEN 10.0::DOUBLE WHEN 'pressure' THEN 12.5::DOUBLE ELSE 20.0::DOUBLE END AS h FROM a WHERE NOT (channel = 'humidity' AND coalesce(agreed, ground) IS NOT NULL AND greatest(value, coalesce(agreed, ground)) >= 95)),
d AS (SELECT *, row_number() OVER (PARTITION BY station_id, channel, mode, observed_at ORDER BY event_id) > 1 AS late FROM m),
n AS (SELECT *, row_number() OVER w AS rn, coalesce(class <> lag(class) OVER w, true) AS fresh, (epoch_us(observed_at) - epoch_us(lag(observed_at) OVER w)) / 1e6 AS gap FROM d WHERE NOT late WINDOW w AS (PARTITION BY station_id, channel, mode ORDER BY observed_at)),
s AS (SELECT *, (CASE WHEN fresh OR gap < 5 THEN 1.0 ELSE least(6.0, greatest(0.0, gap / 600)) END)::DOUBLE AS w FROM n),
f AS (SELECT station_id, channel, mode, event_id, h, rn, r AS ema, greatest(0.0::DOUBLE, (r - k) * w) * pow(0.98::DOUBLE, w) AS up, greatest(0.0::DOUBLE, (-r - k) * w) * pow(0.98::DOUBLE, w) AS down FROM s WHERE rn = 1
UNION ALL SELECT s.station_id, s.channel, s.mode, s.event_id, s.h, s.rn, CASE WHEN fresh THEN r ELSE pow(0.97::DOUBLE, w) * f.ema + (1 - pow(0.97::DOUBLE, w)) * r END, greatest(0.0::DOUBLE, CASE WHEN fresh THEN 0.0 ELSE f.up END + (r - k) * w) * pow(0.98::DOUBLE, w), greatest(0.0::DOUBLE, CASE WHEN fresh THEN 0.0 ELSE f.down END + (-r - k) * w) * pow(0.98::DOUBLE, w) FROM f JOIN s ON s.station_id = f.station_id AND s.channel = f.channel AND s.mode = f.mode AND s.rn = f.rn + 1)
SELECT station_id, channel, mode, event_id, false AS late, round(ema, 6) AS ema, round(least(1.0, greatest(up, down) / (2 * h)), 6) AS score FROM f UNION ALL SELECT station_id, channel, mode, event_id, true, NULL, NULL FROM d WHERE late""",
)
def q_channel_drift(spark, sf):
    obs = observations(spark, sf).withColumn("class", F.expr(_CLASS))
    long = obs.select(
        "station_id", "event_id", F.unix_micros(c("observed_at").cast("timestamp")).alias("observed_us"), c("class").alias("source"),
        F.explode(F.array(*[F.struct(F.lit(x).alias("channel"), c(x).alias("value")) for x in _CHANNELS])).alias("of"),
    ).select("station_id", "event_id", "observed_us", "source", "of.*")
    readings = long.withColumns({"consensus": F.expr(_AGREED), "background": F.expr(_GROUND)})
    out = CD.channel_drift_batch(CD.channel_residuals(readings))
    return out.select("station_id", "channel", "mode", "event_id", "late", *[F.round(x, 6).alias(x) for x in ("ema", "score")])


_MOVED = f"{ST.replace('st AS', 's0 AS', 1)}, st AS (SELECT * REPLACE (CASE WHEN id % 3 = 1 THEN observed_at + INTERVAL '5' MINUTE ELSE observed_at END AS observed_at, CASE WHEN id % 3 = 1 THEN temperature + 1 ELSE temperature END AS temperature) FROM s0)"


@query(
    "ST07_snapshot_scoring",
    _CONS.replace(ST, _MOVED) + " SELECT id, n AS neighbours, round(mean, 5) AS mean, round(z, 4) AS z FROM z WHERE id % 3 > 0",
)
def q_snapshot(spark, sf):
    """A batch of newer and of outdated readings enters the pool before any of it is scored."""
    pool = stations(spark, sf).select("id", "lat", "lon", "source", "observed_at", "temperature")
    shift = F.expr("observed_at + make_dt_interval(0, 0, CASE WHEN id % 3 = 1 THEN 5 ELSE -5 END, 0)")
    batch = pool.where("id % 3 > 0").withColumns({"observed_at": shift, "temperature": c("temperature") + 1})
    held = job.snapshot(pool, batch)
    scored = S.consensus(S.neighbour_edges(held.drop("temperature")), held, "temperature").join(batch.select("id").hint("merge"), "id", "left_semi")
    return scored.select("id", "neighbours", F.round("mean", 5).alias("mean"), (F.round(c("z") * 1e4) / 1e4).alias("z"))


@query(
    "ST16_recovery",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT user_id AS station_id, max(ts) FILTER (ts >= TIMESTAMP '2024-01-25 06:00:00') AS last_observed, count(*) AS replayed, min(ts) AS replay_from FROM a WHERE back <= 20 GROUP BY 1""",
)
def q_recovery(spark, sf):
    return R.recovery(observations(spark, sf), F.expr("timestamp_ntz'2024-01-25 06:00:00'"))


@query(
    "EXT12_EXT13_incident_snapshots",
    f"""WITH {OBS}, {ST}, a AS (SELECT station_id, max(observed_at) AS seen, arg_max(value, (observed_at, event_id)) AS v FROM obs GROUP BY 1),
b AS (SELECT st.id AS station_id, name AS station_name, segment AS region, CASE WHEN v > 60 THEN 'ANOMALY' WHEN v > 30 THEN 'WARNING' ELSE 'NORMAL' END AS status, round(v / 200, 3) AS anomaly_score, round(1 - v / 400, 3) AS confidence, seen AS observed_at, CASE WHEN id % 4 < 2 THEN 'STATIC_SNAPSHOT' ELSE 'LIVE_AWS' END AS source FROM st JOIN a ON a.station_id = st.id WHERE id % 9 > 0)
SELECT * FROM b WHERE status <> 'NORMAL'""",
)
def q_snapshots(spark, sf):
    k = c("id")
    fresh = F.when(k % 4 == 0, "UNKNOWN").when(k % 4 == 2, "LIVE").when(k % 4 == 3, "STALE")
    net = stations(spark, sf).select("id", "name", c("segment").alias("region"), (k % 9 == 0).alias("offline"), fresh.alias("freshness"))
    v = c("value")
    alerts = observations(spark, sf).select(
        "station_id", "event_id", "observed_at", F.when(v > 60, "ANOMALY").when(v > 30, "WARNING").otherwise("NORMAL").alias("status"),
        (v / 200).alias("severity_score"), (1 - v / 400).alias("confidence"),
    )
    return R.incident_snapshots(net, alerts)


_FAULTS = [*E.ESTIMABLE, "CALIBRATION_DRIFT", "GENUINE_EXTREME_WEATHER", "NORMAL"]
_TIERS = ["INSUFFICIENT_DATA", "LOW", "MEDIUM", "HIGH"]
_LAYERED = f"""{OBS}, e AS (SELECT *, CAST(event_id * 7 % 97 AS DOUBLE) / 100 AS l1, CAST(event_id * 11 % 89 AS DOUBLE) / 100 AS tt, CAST(event_id * 13 % 83 AS DOUBLE) / 100 AS tp, CAST(event_id * 17 % 79 AS DOUBLE) / 100 AS th, CAST(event_id * 19 % 73 AS DOUBLE) / 100 AS l4, CAST(event_id * 23 % 71 AS DOUBLE) / 100 AS l3, event_id % 31 = 0 AS veto,
CASE event_id % 5 WHEN 0 THEN 'Temperature out of range' WHEN 1 THEN 'Pressure jump' WHEN 2 THEN 'Humidity and pressure disagree' END AS why FROM obs),
n AS (SELECT *, concat_ws(',', CASE WHEN tt > 0.5 OR l1 > 0.5 AND why ILIKE '%temp%' THEN 'temperature' END, CASE WHEN tp > 0.5 OR l1 > 0.5 AND why ILIKE '%press%' THEN 'pressure' END, CASE WHEN th > 0.5 OR l1 > 0.5 AND why ILIKE '%humid%' THEN 'humidity' END) AS named FROM e),
af AS (SELECT *, CASE WHEN named <> '' THEN named WHEN l4 > 0.5 OR l3 > 0.5 OR veto THEN CASE WHEN temperature IS NOT NULL THEN 'temperature' WHEN pressure IS NOT NULL THEN 'pressure' WHEN humidity IS NOT NULL THEN 'humidity' ELSE '' END ELSE '' END AS affected FROM n)"""


def _with_affected(spark, sf):
    part = lambda factor, modulus: (c("event_id") * factor % modulus).cast("double") / 100
    k = c("event_id") % 5
    why = F.when(k == 0, "Temperature out of range").when(k == 1, "Pressure jump").when(k == 2, "Humidity and pressure disagree")
    affected = E.affected_channels(
        {"temperature": part(11, 89), "pressure": part(13, 83), "humidity": part(17, 79)}, part(7, 97), why, part(19, 73), part(23, 71),
        c("event_id") % 31 == 0, {x: c(x).isNotNull() for x in _CHANNELS},
    )
    return observations(spark, sf).withColumn("affected", affected)


@query("MDL19_affected_channel_rule", f"WITH {_LAYERED} SELECT event_id, affected FROM af")
def q_affected(spark, sf):
    return _with_affected(spark, sf).select("event_id", F.array_join("affected", ",").alias("affected"))


@query(
    "MDL18_estimation_decision",
    f"""WITH {_LAYERED}, g AS (SELECT *, ({_FAULTS})[event_id % {len(_FAULTS)} + 1] AS fault, ({_TIERS})[event_id // 3 % 4 + 1] AS tier, CASE event_id % 6 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'CONTRADICTED' END AS cf, CASE WHEN event_id % 14 = 1 THEN 'REGIONAL_EVENT' END AS ra FROM af),
r AS (SELECT *, CASE WHEN value <= 10 THEN 'NO_ANOMALY' WHEN fault NOT IN ('SENSOR_SPIKE', 'FROZEN_SENSOR', 'SINGLE_CHANNEL_FAULT', 'NOISE_BURST') THEN 'FAULT_NOT_ELIGIBLE' WHEN tier NOT IN ('MEDIUM', 'HIGH') THEN 'CONFIDENCE_TOO_LOW' WHEN cf = 'SUPPORTED' OR ra = 'REGIONAL_EVENT' THEN 'REGION_SUPPORTS_READING' WHEN affected = '' THEN 'NO_CHANNEL' END AS refusal FROM g),
x AS (SELECT *, CASE WHEN refusal IS NULL THEN split_part(affected, ',', 1) END AS channel FROM r)
SELECT event_id, refusal, channel, CASE WHEN channel = 'temperature' THEN coalesce(CASE WHEN event_id % 4 > 0 THEN 20.25 + event_id % 3 END, CASE WHEN humidity > 50 THEN 18.5 END, CASE WHEN event_id % 8 > 0 THEN 19.75 END, 21.0, temperature)::DOUBLE ELSE temperature END AS temperature FROM x""",
)
def q_estimation(spark, sf):
    k = c("event_id")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at % len(names) + 1).cast("int"))
    fault, tier = pick(_FAULTS, k), pick(_TIERS, F.floor(k / 3))
    verdict = E.estimation_decision(
        c("value") > 10, fault, tier, F.when(k % 6 == 0, "SUPPORTED").when(k % 6 == 1, "CONTRADICTED"), F.when(k % 14 == 1, "REGIONAL_EVENT"), c("affected")
    )
    rows = _with_affected(spark, sf).withColumn("verdict", verdict).select("*", "verdict.refusal", "verdict.channel")
    here = F.coalesce(c("channel") == "temperature", F.lit(False))
    value = E.estimated(
        c("temperature"), here, F.when(k % 4 > 0, 20.25 + k % 3), F.when(c("humidity") > 50, 18.5), F.when(k % 8 > 0, 19.75), F.lit(21.0)
    )
    return rows.select("event_id", "refusal", "channel", value.alias("temperature"))


_BUCKETS = ["NORMAL", "LIKELY_SENSOR_ANOMALY", "DATA_QUALITY_VIOLATION", "POSSIBLE_WEATHER_EVENT", "UNCERTAIN"]


@query(
    "EXT34_agreement_rule",
    f"""WITH a AS (SELECT event_id, [event_id * 7 % 97, event_id * 11 % 89, event_id * 13 % 83, event_id * 17 % 79] AS s, event_id % 5 BETWEEN 1 AND 3 AS abnormal FROM events)
SELECT event_id, ((s[1] >= 50) = abnormal)::BIGINT + ((s[2] >= 50) = abnormal)::BIGINT + ((s[3] >= 50) = abnormal)::BIGINT + ((s[4] >= 50) = abnormal)::BIGINT AS agreeing FROM a""",
)
def q_agreement(spark, sf):
    k = c("event_id")
    layers = {"physics": (7, 97), "temporal": (11, 89), "multivariate": (13, 83), "spatial": (17, 79)}
    scores = F.create_map(*[x for name, (a, m) in layers.items() for x in (F.lit(name), (k * a % m).cast("double") / 100)])
    bucket = F.element_at(F.array(*map(F.lit, _BUCKETS)), (k % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", E.layers_agreeing(scores, bucket).cast("long").alias("agreeing"))


@query(
    "EXT30_recount",
    """SELECT count(*) AS live_stations, count(*) FILTER (c_custkey % 7 < 3) AS nominal, count(*) FILTER (c_custkey % 7 IN (3, 4)) AS suspect, count(*) FILTER (c_custkey % 7 = 5) AS degraded, count(*) FILTER (c_custkey % 7 = 6) AS anomaly, count(*) FILTER (c_custkey % 5 = 0) AS stale, count(*) FILTER (c_acctbal > 5000) AS watch,
count(*) FILTER (c_custkey % 11 = 0) AS weather_events, count(*) FILTER (c_custkey % 3 = 0) AS simulated, count(*) FILTER (c_custkey % 3 > 0) AS measured FROM customer""",
)
def q_recount(spark, sf):
    k = c("id")
    status = F.when(k % 7 < 3, "nominal").when(k % 7 < 5, "suspect").when(k % 7 == 5, "degraded").otherwise("anomaly")
    net = stations(spark, sf).select(
        status.alias("overall_status"), F.when(k % 5 == 0, "STALE").otherwise("LIVE").alias("freshness"), (c("temperature") > 25).alias("watch"),
        F.when(k % 11 == 0, "likely_weather_event").alias("interpretation"), (c("source") == "SIMULATED_AWS").alias("simulated"),
    )
    return R.network_recount(net)


@query("SRT08_map_lines", f"WITH {EDGES} SELECT id, list(nb ORDER BY distance, nb)[1:3]::VARCHAR AS lines FROM ed GROUP BY id")
def q_lines(spark, sf):
    nearest = edges_of(spark, sf).where("rank <= 3").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("n"))
    ids = F.transform("n", lambda x: x["neighbour"].cast("string"))
    return nearest.select("id", F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")).alias("lines"))


@query("FN17_seeds", "SELECT event_id, ('0x' || substr(sha1(user_id::VARCHAR || '|' || event_type || '|' || event_id::VARCHAR), 1, 8))::BIGINT AS seed FROM events")
def q_seeds(spark, sf):
    parts = F.concat_ws("|", c("user_id").cast("string"), "event_type", c("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", F.conv(F.substring(F.sha1(parts), 1, 8), 16, 10).cast("long").alias("seed"))
