"""Queries for sources, sinks, read models, listings, evaluation and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import physics as P
from ..operators import cells as CE
from ..operators import history as H
from ..operators import normalise as N
from ..operators import quantiles as QS
from ..operators import spatial as S
from ..operators import temporal as T
from ..operators import vectors as VE
from ..sources import records as R
from .network_queries import PAIRS, verdicts
from .registry import query
from .stand_ins import OBSERVATIONS_SQL as OBS
from .stand_ins import STATIONS_SQL as ST
from .stand_ins import observations, stations, table

c = F.col
W = T.ordered
OW = "(PARTITION BY station_id ORDER BY observed_at, event_id)"


def r6(x):
    return F.round(x, 6)


_ISD = {
    "TMP": "CASE WHEN event_id % 15 = 0 THEN '+9999,9' ELSE '+' || lpad(CAST(100 + event_id % 250 AS VARCHAR), 4, '0') || ',' || CAST(event_id % 5 AS VARCHAR) END",
    "DEW": "'+' || lpad(CAST(50 + event_id % 100 AS VARCHAR), 4, '0') || ',1'",
    "SLP": "CASE WHEN event_id % 11 = 0 THEN '99999,9' ELSE lpad(CAST(9900 + event_id % 400 AS VARCHAR), 5, '0') || ',1' END",
    "WND": "'180,1,N,' || lpad(CAST(event_id % 200 AS VARCHAR), 4, '0') || ',1'",
}


@query(
    "SRC05_isd_records",
    f"""WITH a AS (SELECT event_id, {', '.join(f'{v} AS {k}' for k, v in _ISD.items())} FROM events),
b AS (SELECT event_id, CASE WHEN TMP LIKE '%9999,%' OR split_part(TMP, ',', 2) IN ('2','3','6','7') THEN NULL ELSE ltrim(split_part(TMP, ',', 1), '+')::DOUBLE / 10 END AS t, ltrim(split_part(DEW, ',', 1), '+')::DOUBLE / 10 AS d,
CASE WHEN SLP LIKE '99999%' THEN NULL ELSE split_part(SLP, ',', 1)::DOUBLE / 10 END AS p, split_part(WND, ',', 4)::DOUBLE / 10 * 3.6 AS w FROM a)
SELECT event_id, t AS temperature, d AS dew_point, p AS pressure, round(w, 6) AS wind_speed, round(CASE WHEN t IS NOT NULL THEN greatest(0.0, least(100.0, 100 * exp(17.625 * d / (243.04 + d)) / exp(17.625 * t / (243.04 + t)))) END, 5) AS humidity FROM b""",
)
def q_isd(spark, sf):
    raw = table(spark, sf, "events").selectExpr("event_id", *[f"{v.replace('VARCHAR', 'STRING')} AS {k}" for k, v in _ISD.items()])
    out = R.parse_isd(raw)
    return out.select("event_id", "temperature", "dew_point", "pressure", r6(c("wind_speed")).alias("wind_speed"), F.round("humidity", 5).alias("humidity"))


_PAYLOAD = """CASE event_id % 4 WHEN 0 THEN '{"id": "s' || event_id || '", "temperature": ' || (event_id % 40) || ', "pressure": 1010}'
WHEN 1 THEN '{"ID": "s' || event_id || '", "tempf": ' || (50 + event_id % 40) || ', "baromin": 30, "windspeedmph": 10}'
WHEN 2 THEN '{"station_id": "s' || event_id || '", "outTemp": ' || (60 + event_id % 30) || ', "barometer": 29, "unit_system": "US"}' ELSE '{"x": 1}' END"""


@query(
    "SRC06_payload_adapter",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'native' WHEN 1 THEN 'wu' WHEN 2 THEN 'weewx' ELSE 'error' END AS shape, CASE WHEN event_id % 4 < 3 THEN 's' || event_id END AS station_id,
round(CASE event_id % 4 WHEN 0 THEN event_id % 40 WHEN 1 THEN (50 + event_id % 40 - 32) * 5::DOUBLE / 9 WHEN 2 THEN (60 + event_id % 30 - 32) * 5::DOUBLE / 9 END::DOUBLE, 6) AS temperature,
round(CASE event_id % 4 WHEN 0 THEN 1010 WHEN 1 THEN 30 * 33.8638866667::DOUBLE WHEN 2 THEN 29 * 33.8638866667::DOUBLE END::DOUBLE, 6) AS pressure FROM events""",
)
def q_payload(spark, sf):
    made = table(spark, sf, "events").selectExpr("event_id", f"{_PAYLOAD} AS payload").select("event_id", R.adapt_payload(c("payload")).alias("x"))
    return made.select("event_id", "x.shape", "x.station_id", r6(c("x.temperature")).alias("temperature"), r6(c("x.pressure")).alias("pressure"))


@query(
    "SRC07_observed_time",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-01 00:00:00' + event_id * INTERVAL '1' SECOND WHEN 1 THEN TIMESTAMP '2024-03-01 10:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS observed_at FROM events",
)
def q_time(spark, sf):
    text = F.expr("CASE event_id % 3 WHEN 0 THEN CAST(1704067200 + event_id AS STRING) WHEN 1 THEN '2024-03-01T10:00:00' ELSE 'soon' END")
    at = R.observed_time(text, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", at.cast("timestamp_ntz").alias("observed_at"))


@query(
    "SRC02_catalogue_scan",
    f"""WITH {ST}, a AS (SELECT id % 700 AS id, lat, lon, id AS row FROM st WHERE segment = 'BUILDING' AND lat BETWEEN 6 AND 38 AND lon BETWEEN 68 AND 98)
SELECT id, arg_max(lat, row) AS lat, arg_max(lon, row) AS lon FROM a WHERE id NOT IN (SELECT n_nationkey FROM nation) GROUP BY id""",
)
def q_catalogue(spark, sf):
    rows = stations(spark, sf).select((c("id") % 700).alias("id"), "lat", "lon", c("id").alias("row"), "segment")
    known = table(spark, sf, "nation").select(c("n_nationkey").cast("long").alias("id"))
    return R.station_scan(rows, c("segment") == "BUILDING", known)[0]


@query("SRC10_poll_round", "SELECT c_custkey AS id FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 75")
def q_poll(spark, sf):
    return R.poll_round(stations(spark, sf).select("id"), "id", 25, 3)


@query("SRC14_scenarios", "SELECT * FROM (VALUES ('normal', 6), ('spike', 4), ('frozen', 14), ('drop', 4)) t(scenario_id, steps)")
def q_scenarios(spark, sf):
    return R.scenario_steps(spark).groupBy("scenario_id").agg(F.count("*").cast("int").alias("steps"))


@query(
    "SRC15_grid_field",
    "SELECT round(a.range * 5 - 87.5::DOUBLE, 4) AS lat, round(b.range * 5 - 177.5::DOUBLE, 4) AS lon, round(28 * cos(radians(a.range * 5 - 87.5::DOUBLE)) - 6 + 3 * sin(radians((b.range * 5 - 177.5::DOUBLE) * 2)), 5) AS temperature, (CASE WHEN abs(a.range * 5 - 87.5) < 30 THEN -6.0 WHEN abs(a.range * 5 - 87.5) < 60 THEN 9.0 ELSE -4.0 END)::DOUBLE AS u FROM range(36) a, range(72) b",
)
def q_grid(spark, sf):
    return R.gridded_field(spark).select(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("temperature", 5).alias("temperature"), "u")


@query("SRC13_synthetic_normal")
def q_synthetic(spark, sf):
    return R.synthetic_normal(spark, 20, 288)


@query("SNK02_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'")
def q_retention(spark, sf):
    return table(spark, sf, "events").where(c("ts") >= F.expr("timestamp_ntz'2024-01-10 00:00:00'")).select("event_id")


@query("SNK03_event_replay", "SELECT event_id AS id, event_type AS type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 2000")
def q_replay(spark, sf):
    return table(spark, sf, "events").where("event_id > 500").orderBy("event_id").limit(2000).select(c("event_id").alias("id"), c("event_type").alias("type"))


@query(
    "PRJ15_data_quality",
    f"""WITH {OBS}, a AS (SELECT event_id, (temperature IS NULL)::INT + (pressure IS NULL)::INT + (humidity IS NULL)::INT AS m FROM obs) SELECT event_id, CASE WHEN m = 0 THEN 'VALID' WHEN m < 3 THEN 'DEGRADED' ELSE 'INSUFFICIENT_DATA' END AS quality, m AS missing FROM a""",
)
def q_data_quality(spark, sf):
    missing = c("temperature").isNull().cast("int") + c("pressure").isNull().cast("int") + c("humidity").isNull().cast("int")
    state = F.when(missing == 0, "VALID").when(missing < 3, "DEGRADED").otherwise("INSUFFICIENT_DATA")
    return observations(spark, sf).select("event_id", state.alias("quality"), missing.alias("missing"))


@query(
    "PRJ17_explanations",
    """WITH a AS (SELECT event_id, CAST(event_id % 101 AS DOUBLE) / 100 AS conf FROM events) SELECT event_id, CASE WHEN conf >= 0.8 THEN 'HIGH' WHEN conf >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
CASE WHEN conf >= 0.8 THEN 'Replace or recalibrate the sensor.' WHEN conf >= 0.5 THEN 'Inspect the sensor before acting.' ELSE 'Keep watching; evidence is thin.' END AS action FROM a""",
)
def q_explain(spark, sf):
    conf = (c("event_id") % 101).cast("double") / 100
    tier = F.when(conf >= 0.8, "HIGH").when(conf >= 0.5, "MEDIUM").otherwise("LOW")
    action = (
        F.when(tier == "HIGH", "Replace or recalibrate the sensor.")
        .when(tier == "MEDIUM", "Inspect the sensor before acting.")
        .otherwise("Keep watching; evidence is thin.")
    )
    return table(spark, sf, "events").select("event_id", tier.alias("tier"), action.alias("action"))


@query(
    "PRJ20_hazard_level",
    f"""WITH {OBS} SELECT event_id, CASE WHEN wind_speed >= 100 OR temperature >= 39 THEN 'D5' WHEN wind_speed >= 80 THEN 'D4' WHEN wind_speed >= 60 THEN 'D3' WHEN wind_speed >= 40 OR pressure < 992 THEN 'D2' WHEN wind_speed >= 20 THEN 'D1' ELSE 'D0' END AS level FROM obs""",
)
def q_hazard(spark, sf):
    w = c("wind_speed")
    level = (
        F.when((w >= 100) | (c("temperature") >= 39), "D5").when(w >= 80, "D4").when(w >= 60, "D3").when((w >= 40) | (c("pressure") < 992), "D2").when(w >= 20, "D1").otherwise("D0")
    )
    return observations(spark, sf).select("event_id", level.alias("level"))


@query(
    "FLT07_clean_stations",
    f"""WITH {OBS}, g AS (SELECT station_id, count(*) AS n, count(*) FILTER (temperature IS NULL) AS miss, stddev_samp(value) AS sd FROM obs GROUP BY 1)
SELECT station_id, CASE WHEN n < 60 THEN 'too_few' WHEN miss * 10 > n THEN 'too_many_missing' WHEN sd < 1 THEN 'constant' ELSE 'clean' END AS verdict FROM g""",
)
def q_clean(spark, sf):
    g = observations(spark, sf).groupBy("station_id").agg(F.count("*").alias("n"), F.count_if(c("temperature").isNull()).alias("miss"), F.stddev_samp("value").alias("sd"))
    verdict = F.when(c("n") < 60, "too_few").when(c("miss") * 10 > c("n"), "too_many_missing").when(c("sd") < 1, "constant").otherwise("clean")
    return g.select("station_id", verdict.alias("verdict"))


@query(
    "FLT09_incident_listing",
    """WITH w AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1) SELECT c_custkey, last_order FROM customer LEFT JOIN w ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def q_listing(spark, sf):
    last = table(spark, sf, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))
    some = table(spark, sf, "customer").where(c("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return some.join(last, "c_custkey", "left").select("c_custkey", "last_order")


@query("FLT10_eligibility", "SELECT event_id FROM events WHERE value > 45 AND event_type <> 'view'")
def q_eligible(spark, sf):
    return verdicts(spark, sf).where(c("status").isin("WARNING", "ANOMALY") & (c("root_cause") != "view")).select("event_id")


@query("JN06_reference_join", f"WITH {ST}, r AS (SELECT DISTINCT round(lat, 1) AS la, round(lon, 1) AS lo FROM st WHERE id % 4 = 0) SELECT id, la IS NOT NULL AS known FROM st LEFT JOIN r ON round(lat, 1) = la AND round(lon, 1) = lo")
def q_ref_join(spark, sf):
    keyed = stations(spark, sf).select("id", F.round("lat", 1).alias("la"), F.round("lon", 1).alias("lo"))
    ref = keyed.where("id % 4 = 0").select("la", "lo").distinct().withColumn("known", F.lit(True))
    return keyed.join(ref, ["la", "lo"], "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


@query("JN09_anti_join", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders)")
def q_anti(spark, sf):
    return table(spark, sf, "events").join(table(spark, sf, "orders").select(c("o_orderkey").alias("event_id")), "event_id", "left_anti").select("event_id")


@query("JN10_semi_join", "SELECT event_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0)")
def q_semi(spark, sf):
    ids = table(spark, sf, "supplier").where("s_suppkey % 7 = 0").select(c("s_suppkey").alias("user_id"))
    return table(spark, sf, "events").join(ids, "user_id", "left_semi").select("event_id")


@query(
    "AGG04_station_summary",
    f"WITH {ST}, a AS (SELECT *, CASE WHEN temperature > 27 THEN 'ANOMALY' WHEN temperature > 24 THEN 'WARNING' ELSE 'NORMAL' END AS status FROM st) SELECT status, id FROM a QUALIFY row_number() OVER (PARTITION BY status ORDER BY id) <= 30",
)
def q_summary(spark, sf):
    t = c("temperature")
    marked = stations(spark, sf).select("id", F.when(t > 27, "ANOMALY").when(t > 24, "WARNING").otherwise("NORMAL").alias("status"))
    w = Window.partitionBy("status").orderBy("id")
    return marked.withColumn("rn", F.row_number().over(w)).where("rn <= 30").select("status", "id")


@query("AGG09_registry", f"WITH {ST} SELECT nation, min(lat) AS lo, max(lat) AS hi, min(lat) = max(lat) AS fixed FROM st GROUP BY nation")
def q_registry(spark, sf):
    return stations(spark, sf).groupBy("nation").agg(F.min("lat").alias("lo"), F.max("lat").alias("hi"), (F.min("lat") == F.max("lat")).alias("fixed"))


@query(
    "AGG11_pooled_baseline",
    f"WITH {OBS}, b AS (SELECT floor(value / 0.1 + 0.5)::BIGINT AS bin, count(*) AS n FROM obs GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY bin) AS run, sum(n) OVER () AS tot FROM b) SELECT 'all' AS pool, round(min(bin) * 0.1::DOUBLE, 6) AS median, max(tot)::BIGINT AS n FROM r WHERE run * 2 >= tot",
)
def q_pooled(spark, sf):
    out = H.histogram_median(observations(spark, sf).withColumn("pool", F.lit("all")), ["pool"], "value")
    return out.select("pool", r6(c("median")).alias("median"), c("n").cast("long").alias("n"))


@query("AGG12_spacing", f"WITH {PAIRS}, m AS (SELECT id, min(km) AS km FROM pr WHERE id <> nb GROUP BY id) SELECT round(min(km), 4) AS nearest, round(median(km), 4) AS median, round(quantile_cont(km, 0.75), 4) AS p75, round(max(km), 4) AS widest FROM m")
def q_spacing(spark, sf):
    spacing = CE.nearest_anywhere(stations(spark, sf).select("id", "lat", "lon"), 1, exact=True)
    found = H.percentile_quartiles(spacing, "distance")
    return found.select(*[F.round(x, 4).alias(x) for x in ("nearest", "median", "p75", "widest")])


@query("AGG14_residuals", "SELECT event_type, round(avg(value - 40), 6) AS mean, round(stddev_pop(value - 40), 6) AS spread, round(sqrt(avg((value - 40) * (value - 40))), 6) AS rmse, round(quantile_cont(abs(value - 40), 0.99), 6) AS p99 FROM events GROUP BY 1")
def q_residuals(spark, sf):
    r = c("value") - 40
    events = table(spark, sf, "events")
    plain = events.groupBy("event_type").agg(r6(F.avg(r)).alias("mean"), r6(F.stddev_pop(r)).alias("spread"), r6(F.sqrt(F.avg(r * r))).alias("rmse"))
    tail = QS.quantiles(events.select("event_type", F.abs(r).alias("size")), ["event_type"], "size", {"p99": 0.99})
    return plain.join(tail.select("event_type", r6(c("p99")).alias("p99")), "event_type")


@query(
    "AGG17_onset_delay",
    f"WITH {OBS}, n AS (SELECT *, row_number() OVER {OW} AS i FROM obs), d AS (SELECT station_id, min(i) FILTER (i >= 10 AND value > 60) - 10 AS delay FROM n GROUP BY 1) SELECT round(median(delay), 4) AS median, round(quantile_cont(delay, 0.9), 4) AS p90, count(delay) AS detected FROM d",
)
def q_onset(spark, sf):
    n = observations(spark, sf).withColumn("i", F.row_number().over(W()))
    d = n.groupBy("station_id").agg((F.min(F.when((c("i") >= 10) & (c("value") > 60), c("i"))) - 10).alias("delay"))
    found = QS.quantiles(d, [], "delay", {"median": 0.5, "p90": 0.9})
    return found.select(F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"), c("n").alias("detected"))


@query("AGG24_neighbour_counts", f"WITH {PAIRS}, k AS (SELECT id, count(*) FILTER (km <= 50 AND id <> nb) AS n FROM pr GROUP BY id) SELECT min(n) AS least, median(n) AS median, max(n) AS most, round(avg(n), 6) AS mean FROM k")
def q_counts(spark, sf):
    points = stations(spark, sf).select("id", "lat", "lon")
    n = durable(S.others_within(points, 50.0))
    plain = n.agg(F.min("others").alias("least"), F.max("others").alias("most"), r6(F.avg("others")).alias("mean"))
    middle = QS.quantiles(n, [], "others", {"median": 0.5}).select("median")
    return plain.unionByName(middle, allowMissingColumns=True).agg(*[F.max(x).alias(x) for x in ("least", "median", "most", "mean")])


@query("AGG25_cluster_rollup", f"WITH {ST} SELECT floor(lat)::BIGINT AS y, floor(lon)::BIGINT AS x, count(*) AS n, count(*) FILTER (temperature > 25) AS hot FROM st GROUP BY ALL")
def q_rollup(spark, sf):
    return stations(spark, sf).groupBy(F.floor("lat").alias("y"), F.floor("lon").alias("x")).agg(F.count("*").alias("n"), F.count_if(c("temperature") > 25).alias("hot"))


@query("AGG26_distinct", f"WITH {ST} SELECT DISTINCT round(lat, 1) AS la, round(lon, 1) AS lo FROM st")
def q_distinct(spark, sf):
    return stations(spark, sf).select(F.round("lat", 1).alias("la"), F.round("lon", 1).alias("lo")).distinct()


@query("AGG28_calibration", "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events), p AS (SELECT *, least(1.0::DOUBLE, 0.999::DOUBLE * (1 + 1.0::DOUBLE / n)) * (n - 1) AS pos FROM r) SELECT round(max(value) FILTER (i = floor(pos)) + (max(value) FILTER (i = ceil(pos)) - max(value) FILTER (i = floor(pos))) * (max(pos) - floor(max(pos))), 6) AS threshold FROM p")
def q_calibration(spark, sf):
    level = F.least(F.lit(1.0), F.lit(0.999) * (1 + F.lit(1.0) / c("n")))
    return QS.quantiles(table(spark, sf, "events"), [], "value", {"threshold": level}).select(r6(c("threshold")).alias("threshold"))


@query("SRT01_nearest_three", f"WITH {PAIRS} SELECT id, nb AS neighbour FROM pr WHERE id <> nb AND km <= 200 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(km, 3), nb) <= 3")
def q_three(spark, sf):
    points = stations(spark, sf).select("id", "lat", "lon")
    return CE.nearest(points, 3, 200.0).select("id", "neighbour")


@query("SRT05_by_distance", f"WITH {PAIRS} SELECT nb AS id, round(km, 3) AS km FROM pr WHERE id = 1 ORDER BY round(km, 3), nb LIMIT 50")
def q_by_distance(spark, sf):
    points = stations(spark, sf).select("id", "lat", "lon")
    seed = points.where("id = 1").first()
    km = F.round(P.haversine_km(F.lit(seed["lat"]), F.lit(seed["lon"]), c("lat"), c("lon")), 3)
    return points.select("id", km.alias("km")).orderBy("km", "id").limit(50)


@query("SRT07_first_per_group", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 5")
def q_first_n(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, sf, "customer").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("c_nationkey", "c_custkey")


@query("SRT09_split", "SELECT c_custkey, CASE WHEN crc < 70 THEN 'train' WHEN crc < 85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT c_custkey, c_custkey * 2654435761 % 100 AS crc FROM customer)")
def q_split(spark, sf):
    u = c("c_custkey") * 2654435761 % 100
    return table(spark, sf, "customer").select("c_custkey", F.when(u < 70, "train").when(u < 85, "validation").otherwise("test").alias("split"))


@query("SRT10_stratified_sample", "WITH g AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT c_custkey FROM customer JOIN g USING (c_nationkey) WHERE (c_custkey * 2654435761 % 1000) / 1000.0 < least(1.0, 20.0 / n)")
def q_strata(spark, sf):
    customers = table(spark, sf, "customer")
    n = customers.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    u = (c("c_custkey") * 2654435761 % 1000) / 1000
    return customers.join(n, "c_nationkey").where(u < F.least(F.lit(1.0), 20.0 / c("n"))).select("c_custkey")


@query("SET05_unions", "SELECT n_regionkey AS region, array_to_string(list_sort(list_distinct(list(substr(n_name, 1, 1)))), '') AS initials FROM nation GROUP BY 1")
def q_unions(spark, sf):
    return table(spark, sf, "nation").groupBy(c("n_regionkey").alias("region")).agg(F.concat_ws("", F.array_sort(F.collect_set(F.substring("n_name", 1, 1)))).alias("initials"))


@query("FN07_FN10_corrections", f"WITH {ST} SELECT id, round((temperature - 24) / greatest(1.2 * 1.4826, 0.5), 6) AS z, round(temperature - 0.0065::DOUBLE * (100 - elevation), 6) AS lapsed, round(pressure - 0.12::DOUBLE * (100 - elevation), 6) AS pressure FROM st")
def q_corrections(spark, sf):
    up = 100 - c("elevation")
    return stations(spark, sf).select(
        "id",
        r6(P.robust_z(c("temperature"), F.lit(24.0), F.lit(1.2), 0.5)).alias("z"),
        r6(c("temperature") - 0.0065 * up).alias("lapsed"),
        r6(c("pressure") - 0.12 * up).alias("pressure"),
    )


@query("FN14_quantise", "SELECT event_id, round(round(value / 0.25) * 0.25, 4) AS stepped, round(3 * sin(2 * pi() * (hour(ts) - 9) / 24), 6) AS diurnal FROM events")
def q_quantise(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.round(F.round(c("value") / 0.25) * 0.25, 4).alias("stepped"), r6(3 * F.sin(2 * F.pi() * (F.hour("ts") - 9) / 24)).alias("diurnal")
    )


@query("FN15_suffix_parsing", "SELECT event_id, try_cast(regexp_extract(raw, '^(-?[0-9.]+) ?(°C|km/h)$', 1) AS DOUBLE) AS value, nullif(regexp_extract(raw, '^(-?[0-9.]+) ?(°C|km/h)$', 2), '') AS unit FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 40) || '.5 °C' WHEN 1 THEN (event_id % 90) || 'km/h' ELSE 'n/a' END AS raw FROM events)")
def q_suffix(spark, sf):
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN concat(event_id % 40, '.5 °C') WHEN 1 THEN concat(event_id % 90, 'km/h') ELSE 'n/a' END")
    pattern = "^(-?[0-9.]+) ?(°C|km/h)$"
    return table(spark, sf, "events").select(
        "event_id", F.regexp_extract(raw, pattern, 1).try_cast("double").alias("value"), F.nullif(F.regexp_extract(raw, pattern, 2), F.lit("")).alias("unit")
    )


@query("FN18_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("FN19_dominant_channel", f"WITH {OBS}, a AS (SELECT event_id, coalesce(abs(temperature - 25) / 8, -1) AS t, coalesce(abs(pressure - 1015) / 14, -1) AS p, coalesce(abs(humidity - 65) / 20, -1) AS h FROM obs) SELECT event_id, CASE WHEN t >= p AND t >= h THEN 'temperature' WHEN p >= h THEN 'pressure' ELSE 'humidity' END AS channel, round(greatest(t, p, h), 6) AS z FROM a")
def q_dominant(spark, sf):
    parts = {"temperature": (25, 8), "pressure": (1015, 14), "humidity": (65, 20)}
    zs = F.array(*[F.coalesce(F.abs(c(n) - m) / s, F.lit(-1.0)) for n, (m, s) in parts.items()])
    names = F.array(*[F.lit(n) for n in parts])
    at = F.array_position(zs, F.array_max(zs)).cast("int")
    return observations(spark, sf).select("event_id", F.element_at(names, at).alias("channel"), r6(F.array_max(zs)).alias("z"))


@query("FN20_periods", "SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1995 THEN 0 WHEN year(o_orderdate) <= 1997 THEN 1 ELSE 2 END AS period, ((month(o_orderdate) + 5) % 12 + 1)::INT AS opposite FROM orders")
def q_periods(spark, sf):
    y = F.year("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(y <= 1995, 0).when(y <= 1997, 1).otherwise(2).alias("period"), ((F.month("o_orderdate") + 5) % 12 + 1).cast("int").alias("opposite")
    )


@query(
    "FN22_MDL24_fault_injection",
    f"""WITH {OBS}, n AS (SELECT event_id, station_id, value, row_number() OVER {OW} AS i FROM obs) SELECT event_id, round(CASE WHEN i BETWEEN 20 AND 29 THEN CASE station_id % 4 WHEN 0 THEN value + 15 WHEN 1 THEN 25.0 WHEN 2 THEN value + (i - 20) * 0.4::DOUBLE ELSE NULL END ELSE value END, 6) AS value, i BETWEEN 20 AND 29 AS injected FROM n""",
)
def q_inject(spark, sf):
    n = observations(spark, sf).withColumn("i", F.row_number().over(W()))
    kind = c("station_id") % 4
    hit = c("i").between(20, 29)
    faulty = F.when(kind == 0, c("value") + 15).when(kind == 1, 25.0).when(kind == 2, c("value") + (c("i") - 20) * 0.4)
    return n.select("event_id", r6(F.when(hit, faulty).otherwise(c("value"))).alias("value"), hit.alias("injected"))


@query("EXT01_range_scan", f"WITH {OBS} SELECT event_id, station_id, observed_at FROM obs WHERE station_id IN (1, 5, 9) AND observed_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY station_id, observed_at")
def q_range(spark, sf):
    some = observations(spark, sf).where(c("station_id").isin(1, 5, 9) & F.expr("observed_at BETWEEN timestamp_ntz'2024-01-05' AND timestamp_ntz'2024-01-20'"))
    return some.select("event_id", "station_id", "observed_at").orderBy("station_id", "observed_at")


@query("EXT03_store_stats", "SELECT count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, count(DISTINCT user_id) AS stations FROM events")
def q_stats(spark, sf):
    return table(spark, sf, "events").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.countDistinct("user_id").alias("stations"))


@query("EXT05_context_merge", "SELECT user_id, min(ts) AS first_observation_at, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def q_context(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first_observation_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


@query("EXT08_source_class", f"WITH {ST} SELECT id, CASE WHEN source = 'SIMULATED_AWS' THEN 'SIMULATED' ELSE 'MEASURED' END AS class FROM st")
def q_class(spark, sf):
    return stations(spark, sf).select("id", F.when(c("source") == "SIMULATED_AWS", "SIMULATED").otherwise("MEASURED").alias("class"))


@query("EXT14_offline", f"WITH {OBS} SELECT event_id, CASE WHEN temperature IS NULL AND pressure IS NULL OR event_id % 50 = 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS status, CASE WHEN temperature IS NULL AND pressure IS NULL OR event_id % 50 = 0 THEN 0.0 ELSE value END AS score FROM obs")
def q_offline(spark, sf):
    off = (c("temperature").isNull() & c("pressure").isNull()) | (c("event_id") % 50 == 0)
    return observations(spark, sf).select("event_id", F.when(off, "OFFLINE").otherwise("ONLINE").alias("status"), F.when(off, 0.0).otherwise(c("value")).alias("score"))


@query("EXT17_replay_groups", "SELECT date_trunc('hour', ts) AS at, count(*) AS n, array_to_string(list_sort(list(event_id)), ',') AS ids FROM events GROUP BY 1")
def q_groups(spark, sf):
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")))
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("at")).agg(F.count("*").alias("n"), ids.alias("ids"))


@query("EXT22_normal_traffic", "SELECT event_type AS reason, count(*) AS n, round(avg(CASE WHEN value < 70 THEN 1.0 ELSE 0.0 END), 6) AS quiet FROM events GROUP BY 1")
def q_normal(spark, sf):
    return table(spark, sf, "events").groupBy(c("event_type").alias("reason")).agg(F.count("*").alias("n"), r6(F.avg(F.when(c("value") < 70, 1.0).otherwise(0.0))).alias("quiet"))


@query("EXT25_gating_matrix", f"WITH {OBS}, v AS (SELECT unnest(['none', 'temperature', 'pressure']) AS dropped), x AS (SELECT dropped, (temperature IS NOT NULL AND dropped <> 'temperature')::INT + (pressure IS NOT NULL AND dropped <> 'pressure')::INT + (humidity IS NOT NULL)::INT AS n FROM obs, v) SELECT dropped, CASE WHEN n = 3 THEN 'JOINT' WHEN n = 2 THEN 'PARTIAL' ELSE 'UNAVAILABLE' END AS status, count(*) AS rows FROM x GROUP BY ALL")
def q_gates(spark, sf):
    variants = F.explode(F.array(F.lit("none"), F.lit("temperature"), F.lit("pressure"))).alias("dropped")
    x = observations(spark, sf).select("temperature", "pressure", "humidity", variants)
    n = sum(((c(k).isNotNull()) & (c("dropped") != k)).cast("int") for k in ("temperature", "pressure", "humidity"))
    status = F.when(n == 3, "JOINT").when(n == 2, "PARTIAL").otherwise("UNAVAILABLE")
    return x.groupBy("dropped", status.alias("status")).agg(F.count("*").alias("rows"))


@query("EXT33_error_rate", f"WITH {OBS} SELECT event_id, round(sum(CASE WHEN value > 70 THEN 1 ELSE 0 END) OVER h / count(*) OVER h, 6) AS rate FROM obs WINDOW h AS (PARTITION BY station_id ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING)")
def q_errors(spark, sf):
    h = W().rowsBetween(Window.unboundedPreceding, 0)
    return observations(spark, sf).select("event_id", r6(F.sum(F.when(c("value") > 70, 1).otherwise(0)).over(h) / F.count("*").over(h)).alias("rate"))


@query("MDL06_standard_scaler", f"WITH {OBS}, s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM obs WHERE station_id % 10 < 7) SELECT event_id, round((value - m) / d, 6) AS z FROM obs, s")
def q_scaler(spark, sf):
    obs = observations(spark, sf)
    m, d = obs.where("station_id % 10 < 7").agg(F.avg("value"), F.stddev_pop("value")).first()  # two numbers
    return obs.select("event_id", r6((c("value") - m) / d).alias("z"))


@query("MDL18_imputation", f"WITH {OBS}, p AS (SELECT *, avg(temperature) OVER (PARTITION BY station_id ORDER BY observed_at, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS recent FROM obs) SELECT event_id, temperature AS raw, round(coalesce(temperature, recent, 20.0), 6) AS estimate, CASE WHEN temperature IS NOT NULL THEN 'observed' WHEN recent IS NOT NULL THEN 'temporal' ELSE 'climatology' END AS basis FROM p")
def q_impute(spark, sf):
    recent = F.avg("temperature").over(W().rowsBetween(-6, -1))
    t = c("temperature")
    basis = F.when(t.isNotNull(), "observed").when(recent.isNotNull(), "temporal").otherwise("climatology")
    return observations(spark, sf).select("event_id", t.alias("raw"), r6(F.coalesce(t, recent, F.lit(20.0))).alias("estimate"), basis.alias("basis"))


@query("MDL19_affected_channels", f"WITH {OBS} SELECT event_id, concat_ws(',', CASE WHEN temperature > 35 THEN 'temperature' END, CASE WHEN pressure > 1030 THEN 'pressure' END, CASE WHEN humidity > 95 THEN 'humidity' END) AS channels FROM obs")
def q_channels(spark, sf):
    limits = {"temperature": 35, "pressure": 1030, "humidity": 95}
    hit = F.array_compact(F.array(*[F.when(c(n) > v, n) for n, v in limits.items()]))
    return observations(spark, sf).select("event_id", F.concat_ws(",", hit).alias("channels"))


@query("MDL23_contribution_classes", "WITH a AS (SELECT user_id, max(value) AS rule, max(value * (event_id % 3)) AS model FROM events GROUP BY 1) SELECT CASE WHEN rule > 70 AND model > 70 THEN 'A' WHEN rule > 70 THEN 'B' WHEN model > 70 THEN 'C' ELSE 'none' END AS class, count(*) AS n FROM a GROUP BY 1")
def q_contribution(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id").agg(F.max("value").alias("rule"), F.max(c("value") * (c("event_id") % 3)).alias("model"))
    rule, model = c("rule") > 70, c("model") > 70
    return per.groupBy(F.when(rule & model, "A").when(rule, "B").when(model, "C").otherwise("none").alias("class")).agg(F.count("*").alias("n"))


@query("ST03_late_split", f"WITH {OBS}, a AS (SELECT event_id, max(observed_at) OVER (PARTITION BY station_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, observed_at FROM obs) SELECT event_id, coalesce(observed_at <= last, false) AS late FROM a")
def q_late(spark, sf):
    arrival = Window.partitionBy("station_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max("observed_at").over(arrival)
    return observations(spark, sf).select("event_id", F.coalesce(c("observed_at") <= last, F.lit(False)).alias("late"))


@query("ST08_pool_merge", f"WITH {ST}, b AS (SELECT id, observed_at, temperature FROM st UNION ALL SELECT id, observed_at + CASE WHEN id % 2 = 0 THEN INTERVAL '5' MINUTE ELSE INTERVAL '-5' MINUTE END, temperature + 1 FROM st) SELECT id, max(observed_at) AS observed_at, round(arg_max(temperature, observed_at), 6) AS temperature FROM b GROUP BY id")
def q_pool_merge(spark, sf):
    from ..streaming.job import snapshot

    pool = stations(spark, sf).select("id", "observed_at", "temperature")
    shifted = F.expr("observed_at + make_dt_interval(0, 0, CASE WHEN id % 2 = 0 THEN 5 ELSE -5 END, 0)")
    batch = pool.select("id", shifted.alias("observed_at"), (c("temperature") + 1).alias("temperature"))
    return snapshot(pool, batch).withColumn("temperature", r6(c("temperature")))


@query("ST17_replay_markers", f"WITH {OBS} SELECT station_id, min(observed_at) FILTER (value > 60) AS warned, min(observed_at) FILTER (value > 110) AS alarmed FROM obs GROUP BY 1")
def q_markers(spark, sf):
    from ..streaming.job import replayed

    return replayed(observations(spark, sf), {"warned": "value > 60", "alarmed": "value > 110"})


@query("EMB01_vector_top_k", "SELECT a.vec_id, b.vec_id AS neighbour FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) <= 5")
def q_vectors(spark, sf):
    """A stated query set (ids divisible by 100) against all vectors."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = table(spark, sf, "embeddings").select(c("vec_id").alias("id"), F.when(~F.exists(e, lambda x: x.isNull()), e).alias("e"))
    return VE.nearest(v, v.where("id % 100 = 0"), 5).select(c("q").alias("vec_id"), c("id").alias("neighbour"))
