"""Queries for logs, retention, references as of a time, and fitted models that are stored as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import shared_path
from ..operators import asof, consistency, ecod, layer4
from ..sources import push
from ..streaming import event_log as EL
from .network_queries import EDGES
from .registry import query
from .stand_ins import OBSERVATIONS_SQL as OBS
from .stand_ins import STATION, observations, stations, table

c = F.col


def r6(x):
    return F.round(x, 6)


@query(
    "SNK03_event_log",
    """WITH n AS (SELECT event_id, event_type AS type, row_number() OVER (ORDER BY ts, event_id) AS id, count(*) OVER () AS last FROM events)
SELECT id, event_id, type, 100 < last - 5000 AS resync FROM n WHERE id > greatest(100, last - 5000)""",
)
def q_event_log(spark, sf):
    """A log of three micro-batches, the last of them tried twice, replayed from event 100 on."""
    events = table(spark, sf, "events").select("event_id", c("ts").cast("timestamp").alias("at"), c("event_type").alias("type"))
    feed, log = shared_path(spark, "feed"), shared_path(spark, "log")
    for days in ("day(at) <= 10", "day(at) BETWEEN 11 AND 20", "day(at) > 20"):
        events.where(days).coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    EL.run_log(stream, log, shared_path(spark, "progress"), ["at", "event_id"])
    EL.append_batch(events.where("day(at) > 20"), 2, log, ["at", "event_id"])
    rows, resync = EL.replay(spark, log, 100, 5000)
    return rows.select("id", "event_id", "type", F.lit(resync).alias("resync"))


@query("SNK02_retention_table", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 06:00:00'")
def q_retention_table(spark, sf):
    """A table by date after a retention run: whole dates dropped, the date of the cutoff swapped."""
    path = shared_path(spark, "kept")
    events = table(spark, sf, "events").select("event_id", "ts", F.to_date("ts").alias("date"))
    events.repartition("date").write.partitionBy("date").parquet(path)
    EL.retain(spark, path, "ts", "2024-01-10 06:00:00")
    return spark.read.schema(events.schema).parquet(path).select("event_id", "ts")


_PLACE = {k: f"round({STATION[k].replace('c_custkey', 'user_id % 40')}, 1)" for k in ("lat", "lon")}


@query(
    "SRC11_JN06_reference_as_of",
    f"""WITH e AS (SELECT event_id, {_PLACE["lat"]} AS lat, {_PLACE["lon"]} AS lon, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS at_s, value FROM events),
r AS (SELECT lat, lon, at_s, max(value) AS value FROM e WHERE event_id % 3 = 0 GROUP BY ALL),
j AS (SELECT e.event_id, e.at_s - r.at_s AS age, r.value FROM (SELECT * FROM e WHERE event_id % 3 > 0) e ASOF LEFT JOIN r ON e.lat = r.lat AND e.lon = r.lon AND e.at_s >= r.at_s)
SELECT event_id, CASE WHEN age <= 86400 THEN value END AS reference, CASE WHEN age <= 86400 THEN age END AS age_s, CASE WHEN age <= 21600 THEN 'FRESH' WHEN age <= 86400 THEN 'STALE' ELSE 'MISSING' END AS state FROM j""",
)
def q_as_of(spark, sf):
    """The last reference of the rounded place at each reading's time: fresh for six hours, served stale for a day."""
    e = table(spark, sf, "events").selectExpr("event_id", *[f"{x} AS {k}" for k, x in _PLACE.items()], "CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS BIGINT) AS at_s", "value")
    out = asof.reference_as_of(e.where("event_id % 3 > 0"), e.where("event_id % 3 = 0"), "event_id", ["lat", "lon"], "at_s", "value", 6 * 3600, 24 * 3600)
    return out.select("event_id", "reference", "age_s", "state")


_CH = list(consistency.CHANNELS)
_TAILS = " + ".join(f"greatest(-ln((le_{x} + 1) / (n + 1)), -ln((ge_{x} + 1) / (n + 1)))" for x in _CH)
_RUNS = ", ".join(
    f"sum(f) OVER (ORDER BY {x} RANGE UNBOUNDED PRECEDING) AS le_{x}, sum(f) OVER (ORDER BY {x} RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ge_{x}" for x in _CH
)


@query(
    "MDL03_ecod_anchors",
    f"""WITH {OBS}, o AS (SELECT event_id, day(observed_at) AS d, (day(observed_at) <= 12)::INT AS f, {", ".join(_CH)} FROM obs WHERE {" AND ".join(f"{x} IS NOT NULL" for x in _CH)}),
k AS (SELECT event_id, d, sum(f) OVER () AS n, {_RUNS} FROM o), s AS (SELECT event_id, d, {_TAILS} AS raw FROM k),
m AS (SELECT quantile_cont(raw, 0.95) AS a, quantile_cont(raw, 0.995) AS b, quantile_cont(raw, 0.9995) AS z FROM s WHERE d BETWEEN 13 AND 20)
SELECT event_id, round(raw, 6) AS raw, round(CASE WHEN raw <= a THEN 0 WHEN raw >= z THEN 1 WHEN raw <= b THEN 0.5 * (raw - a) / (b - a) ELSE 0.5 + 0.5 * (raw - b) / (z - b) END, 6) AS evidence,
round(a, 6) AS center, round(b, 6) AS threshold, round(z, 6) AS extreme FROM s, m WHERE d > 20""",
)
def q_ecod_anchors(spark, sf):
    """Fitted on the first days, anchors from the days after them, evidence for the rest."""
    obs = observations(spark, sf).withColumn("d", F.dayofmonth("observed_at"))
    fit = ecod.fitted(obs.where("d <= 12"), _CH)
    scores = ecod.scored(obs.where("d > 12"), "event_id", _CH, fit).join(obs.select("event_id", "d"), "event_id")
    marks = ecod.anchors(scores.where("d <= 20")).first()
    rest = ecod.with_evidence(scores.where("d > 20 and raw is not null"), marks)
    return rest.select("event_id", *[r6(c(x)).alias(x) for x in ("raw", "evidence", *ecod.ANCHORS)])


#: Stored components of the consistency score (mean, spread, loadings of temperature, pressure, humidity, height).
COMPONENTS = consistency.Components(
    (25.0, 1015.0, 67.5, 300.0), (8.6, 14.4, 21.6, 430.0), ((0.62, -0.41, 0.49, -0.46), (0.31, 0.83, 0.20, -0.42))
)


def _expected_sql(i: int) -> str:
    cases = []
    for seen in consistency.patterns():
        constant, factors = COMPONENTS.formula(i, seen)
        has = " AND ".join(f"{x} IS {'NOT ' if j in seen else ''}NULL" for j, x in enumerate(_CH))
        terms = " + ".join(f"({f!r})::DOUBLE * {'elevation' if j == 3 else _CH[j]}" for j, f in factors.items())
        cases.append(f"WHEN {has} THEN ({constant!r})::DOUBLE + {terms}")
    return f"CASE WHEN {_CH[i]} IS NOT NULL THEN CASE {' '.join(cases)} END END"


@query(
    "MDL05_consistency",
    f"""WITH {OBS}, o AS (SELECT event_id, {", ".join(_CH)}, CAST(station_id * 13 % 1500 AS DOUBLE) AS elevation FROM obs),
x AS (SELECT *, {", ".join(f"{_expected_sql(i)} AS e{i}" for i in range(3))} FROM o),
z AS (SELECT *, coalesce(abs(temperature - e0) / 3.5, 0) AS z0, coalesce(abs(pressure - e1) / (greatest(0.001, abs(e1)) * 6.0 / 100), 0) AS z1, coalesce(abs(humidity - e2) / 12.0, 0) AS z2 FROM x),
w AS (SELECT *, greatest(z0, z1, z2) AS worst_z FROM z)
SELECT event_id, round(e0, 4) AS expected_temperature, round(e1, 4) AS expected_pressure, round(e2, 4) AS expected_humidity,
CASE WHEN worst_z > 0 THEN CASE WHEN z0 = worst_z THEN 'temperature' WHEN z1 = worst_z THEN 'pressure' ELSE 'humidity' END END AS worst,
round(greatest(0, least(1, (worst_z - 2) / 3)) * 0.55::DOUBLE, 6) AS score FROM w""",
)
def q_consistency(spark, sf):
    """Readings against their reconstruction from the stored components."""
    rows = observations(spark, sf).withColumn("elevation", (c("station_id") * 13 % 1500).cast("double"))
    out = consistency.scored(rows, COMPONENTS)
    return out.select("event_id", *[F.round(f"expected_{x}", 4).alias(f"expected_{x}") for x in _CH], "worst", r6(c("consistency")).alias("score"))


# ---- the spatial layer from readings to verdicts

_SHIFTED = {
    "temperature": "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 10 < 2 THEN temperature + 12 ELSE temperature END",
    "pressure": "CASE WHEN id % 7 = 0 THEN pressure - 15 ELSE pressure END",
    "humidity": "CASE WHEN id % 13 = 0 THEN NULL ELSE humidity END",
}
_FLOOR = {"temperature": 1.0, "pressure": 0.8, "humidity": 4.0}
_LONG = " UNION ALL ".join(
    f"SELECT id, elevation, '{x}' AS ch, ({v})::DOUBLE AS v, {_FLOOR[x]}::DOUBLE AS floor, {layer4.LAPSE[x] or 0}::DOUBLE AS lapse FROM st" for x, v in _SHIFTED.items()
)
_WITH_US = "abs(tz) >= 1 AND sign(tz) = sign(rz)"


@query(
    "MDL12_spatial_layer",
    f"""WITH {EDGES}, ch AS ({_LONG}),
x AS (SELECT ed.id, a.ch, a.v AS own, a.floor, CASE WHEN a.ch = 'humidity' THEN greatest(0.0, least(100.0, b.v)) ELSE b.v - coalesce(a.lapse * (a.elevation - b.elevation), 0) END AS e, 1 / pow(greatest(distance, 1.0), 2) AS w
  FROM ed JOIN ch a ON a.id = ed.id JOIN ch b ON b.id = nb AND b.ch = a.ch WHERE b.v IS NOT NULL),
g AS (SELECT id, ch, any_value(own) AS own, any_value(floor) AS floor, count(*) AS n, sum(w * e) / sum(w) AS mean, stddev_pop(e) AS sd, median(e) AS med FROM x GROUP BY id, ch),
m AS (SELECT x.id, x.ch, median(abs(e - med)) AS mad FROM x JOIN g USING (id, ch) GROUP BY ALL),
z AS (SELECT g.*, mad, abs(own - mean) / greatest(sd, floor) AS z, 0.6745 * (own - med) / greatest(mad, floor * 0.6745) AS rz FROM g JOIN m USING (id, ch) WHERE own IS NOT NULL AND n >= 2),
t AS (SELECT x.id, x.ch, x.w, rz, 0.6745 * (x.e - z.med) / greatest(z.mad, z.floor * 0.6745) AS tz FROM x JOIN z USING (id, ch)),
a AS (SELECT id, ch, count(*) FILTER ({_WITH_US}) AS sup, sum(CASE WHEN {_WITH_US} THEN w ELSE 0 END) / sum(w) AS ws, avg(abs(tz)) FILTER ({_WITH_US}) AS size FROM t GROUP BY ALL),
q AS (SELECT *, least(1.0, n / 8.0::DOUBLE) AS cov FROM z JOIN a USING (id, ch)),
r AS (SELECT *, cov * ws * CASE WHEN coalesce(size / abs(rz) BETWEEN 1 / 3.0::DOUBLE AND 3, false) THEN 1 ELSE 0 END AS regional, cov * (1 - sup / n) AS isolated,
  CASE WHEN z > 3 THEN least(least(1.0, (z - 3) / 3 + 0.5), CASE WHEN n >= 5 THEN 1.0 WHEN n >= 3 THEN 0.75 ELSE 0.5 END) ELSE 0.0 END::DOUBLE AS score FROM q),
c AS (SELECT ch.id, ch.ch, coalesce(g.n, 0) AS n, r.score, regional, isolated, CASE WHEN r.id IS NULL THEN 'UNAVAILABLE' WHEN abs(rz) <= 3 THEN 'NOT_ANOMALOUS' WHEN regional > isolated THEN 'REGIONAL' WHEN isolated > regional THEN 'ISOLATED' ELSE 'UNCERTAIN' END AS lean
  FROM ch LEFT JOIN g USING (id, ch) LEFT JOIN r USING (id, ch)),
s AS (SELECT id, max(score) AS score, max(n) AS n, string_agg(ch || ':' || lean, ',' ORDER BY ch) AS channels, count(*) FILTER (lean = 'REGIONAL') AS nr, count(*) FILTER (lean = 'ISOLATED') AS ni,
  max(greatest(regional, isolated)) FILTER (lean IN ('REGIONAL', 'ISOLATED')) AS strongest, coalesce(avg(regional) FILTER (lean IN ('REGIONAL', 'ISOLATED', 'UNCERTAIN')), 0) AS regional,
  coalesce(avg(isolated) FILTER (lean IN ('REGIONAL', 'ISOLATED', 'UNCERTAIN')), 0) AS isolated FROM c GROUP BY id)
SELECT id, CASE WHEN score IS NULL THEN 'INSUFFICIENT_NEIGHBOURS' ELSE 'EVALUATED' END AS state, n AS neighbours, round(score, 4) AS score, channels, round(regional, 5) AS regional, round(isolated, 5) AS isolated,
CASE WHEN score IS NULL OR nr + ni = 0 OR (nr > 0 AND ni > 0) OR coalesce(strongest, 0) <= 0.25 THEN 'UNCERTAIN' WHEN nr > 0 THEN 'REGIONAL' ELSE 'ISOLATED' END AS attribution,
CASE WHEN score IS NULL THEN 'CONTRADICTED' WHEN regional > 0.25 AND regional >= 3 * isolated THEN 'SUPPORTED_REGIONAL' WHEN isolated > 0.25 AND isolated >= 3 * regional THEN 'SUPPORTED_ISOLATED' WHEN regional > 0.25 OR isolated > 0.25 THEN 'AMBIGUOUS' ELSE 'CONTRADICTED' END AS counterfactual FROM s""",
)
def q_layer(spark, sf):
    """Every station against its neighbours, from readings to attribution, in one pass over three channels."""
    readings = stations(spark, sf).withColumns({k: F.expr(v) for k, v in _SHIFTED.items()})
    out = layer4.evaluated(readings)
    rounded = {"score": 4, "regional": 5, "isolated": 5}
    return out.select("id", "state", "neighbours", *[(F.round(c(k) * 10**d) / 10**d).alias(k) for k, d in rounded.items()], "channels", "attribution", "counterfactual")


# ---- pushed observations: requests of up to forty items, some of them bad

_BAD = "CASE WHEN event_id % 17 = 0 THEN 'BAD_STATION_ID' WHEN event_id % 13 = 0 THEN 'BAD_TIME' WHEN event_id % 11 = 0 THEN 'BAD_NUMBER:temperature' END"


@query(
    "SRC08_push_items",
    f"""WITH e AS (SELECT event_id, event_id // 40 AS request, value, CASE WHEN event_id // 40 % 9 = 0 THEN 'NOT_JSON' ELSE {_BAD} END AS reason FROM events),
n AS (SELECT CASE WHEN reason = 'NOT_JSON' THEN request ELSE event_id END AS item, reason, value FROM e)
SELECT coalesce(reason, 'ACCEPTED') AS outcome, count(DISTINCT item) AS items, round(CASE WHEN reason IS NULL THEN max(value) END, 6) AS highest FROM n GROUP BY reason""",
)
def q_push(spark, sf):
    """What becomes of pushed items: counts by reason, and the highest value of those that are scored."""
    e = table(spark, sf, "events").select("event_id", (c("event_id") / 40).cast("long").alias("request"), "ts", "value")
    k = c("event_id")
    item = F.to_json(
        F.struct(
            F.when(k % 17 == 0, "no id!").otherwise(F.concat(F.lit("st-"), k.cast("string"))).alias("station_id"),
            F.when(k % 13 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("observed_at"),
            F.when(k % 11 == 0, "warm").otherwise(c("value").cast("string")).alias("temperature"),
            F.struct(F.lit("forged").alias("origin")).alias("meta"),
        )
    )
    bodies = e.groupBy("request").agg(F.concat(F.lit('{"observations": ['), F.array_join(F.array_sort(F.collect_list(item)), ", "), F.lit("]}")).alias("body"))
    bodies = bodies.withColumn("body", F.when(c("request") % 9 == 0, F.lit("no json")).otherwise(c("body")))
    feed, good, bad = shared_path(spark, "feed"), shared_path(spark, "accepted"), shared_path(spark, "rejected")
    files = spark.sparkContext.defaultParallelism  # of a micro-batch, so that every core judges some
    bodies.repartition(2 * files).write.parquet(feed)
    stream = spark.readStream.schema(bodies.schema).option("maxFilesPerTrigger", files).parquet(feed)
    push.run_push(spark, stream, good, bad, shared_path(spark, "progress"))
    accepted = spark.read.parquet(good).agg(F.lit("ACCEPTED").alias("outcome"), F.count("*").alias("items"), r6(F.max("temperature")).alias("highest"))
    rejected = spark.read.parquet(bad).groupBy(c("reason").alias("outcome")).agg(F.count("*").alias("items"))
    return accepted.unionByName(rejected, allowMissingColumns=True)
