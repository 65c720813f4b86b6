"""Queries for models, regional events and the remaining projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import multivariate as M
from ..operators import temporal as T
from ..operators.tracking import tracked
from .core_queries import temporal_layer
from .network_queries import NOW
from .registry import query
from .stand_ins import OBSERVATIONS_SQL as OBS
from .stand_ins import STATIONS_SQL as ST
from .stand_ins import observations, stations, table

c = F.col
W = T.ordered
CH = ["temperature", "pressure", "humidity"]


@query(
    "WIN02_frozen_run",
    f"""WITH {OBS}, a AS (SELECT *, CASE WHEN abs(temperature - lag(temperature) OVER (PARTITION BY station_id ORDER BY observed_at, event_id)) < 1e-6 THEN 0 ELSE 1 END AS ch FROM obs),
b AS (SELECT *, sum(ch) OVER (PARTITION BY station_id ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT event_id, least(row_number() OVER (PARTITION BY station_id, run ORDER BY observed_at, event_id), 72)::INT AS run_length FROM b""",
)
def q_frozen(spark, sf):
    return T.with_frozen(observations(spark, sf), "temperature", W()).select("event_id", "run_length")


@query(
    "WIN03_modified_z",
    f"""WITH {OBS}, f AS (SELECT event_id, humidity, median(humidity) OVER h AS med, list(humidity) FILTER (humidity IS NOT NULL) OVER h AS hist FROM obs WINDOW h AS (PARTITION BY station_id ORDER BY observed_at, event_id ROWS 71 PRECEDING)),
g AS (SELECT *, list_median(list_transform(hist, lambda x: abs(x - med))) AS mad FROM f) SELECT event_id, round(CASE WHEN len(hist) >= 24 AND humidity IS NOT NULL AND (mad > 1e-3 OR len(list_distinct(hist)) > 1) THEN 0.6745 * abs(humidity - med) / greatest(mad, 1.0) END, 6) AS z FROM g""",
)
def q_z(spark, sf):
    return T.with_modified_z(observations(spark, sf), "humidity", W()).select("event_id", F.round("z", 6).alias("z"))


_GATE = "CASE event_id % 3 WHEN 0 THEN 'MSL' WHEN 1 THEN 'SURFACE' END"


@query(
    "MDL01_multivariate_gate",
    f"""WITH {OBS}, a AS (SELECT event_id, (temperature IS NOT NULL)::INT + (pressure IS NOT NULL)::INT + (humidity IS NOT NULL)::INT AS n, {_GATE} AS conv, event_id % 400 - 50 AS el, CASE WHEN event_id % 5 = 0 THEN 'GLOBAL_FALLBACK' ELSE 'CITY' END AS scope FROM obs)
SELECT event_id, CASE WHEN n = 3 AND coalesce(conv = 'MSL' OR (conv = 'SURFACE' AND el > 0), false) AND scope = 'CITY' THEN 'JOINT' WHEN n >= 2 THEN 'PARTIAL' ELSE 'UNAVAILABLE' END AS gate FROM a""",
)
def q_gate(spark, sf):
    obs = observations(spark, sf)
    scope = F.when(c("event_id") % 5 == 0, "GLOBAL_FALLBACK").otherwise("CITY")
    return obs.select("event_id", M.gate([c(x).isNotNull() for x in CH], F.expr(_GATE), c("event_id") % 400 - 50, scope).alias("gate"))


@query(
    "MDL03_city_baseline",
    f"WITH {OBS}, m AS (SELECT source, median(temperature) AS tm, median(pressure) AS pm FROM obs GROUP BY 1) SELECT source, round(any_value(tm), 6) AS temperature_median, round(any_value(pm), 6) AS pressure_median, round(median(abs(temperature - tm)), 6) AS temperature_mad, round(median(abs(pressure - pm)), 6) AS pressure_mad FROM obs JOIN m USING (source) GROUP BY source",
)
def q_baseline(spark, sf):
    out = M.robust_baseline(observations(spark, sf), ["source"], ["temperature", "pressure"])
    return out.select("source", *[F.round(x, 6).alias(x) for x in ("temperature_median", "pressure_median", "temperature_mad", "pressure_mad")])


@query("MDL02_isolation_forest")
def q_forest(spark, sf):
    return M.isolation_scores(observations(spark, sf), "event_id", CH)


@query("MDL04_next_step_residual")
def q_next_step(spark, sf):
    out, _ = M.next_step_residuals(observations(spark, sf), "value", W())
    return out.select("event_id", F.round("residual", 6).alias("residual"))


@query(
    "MDL08_candidates",
    f"""WITH {ST}, z AS (SELECT id, (temperature - 24) / 3 AS t, (pressure - 1008) / 6 AS p, (humidity - 65) / 20 AS h FROM st) SELECT id, CASE WHEN abs(t) >= abs(p) AND abs(t) >= abs(h) THEN 'temperature' WHEN abs(p) >= abs(h) THEN 'pressure' ELSE 'humidity' END AS channel,
CASE WHEN CASE WHEN abs(t) >= abs(p) AND abs(t) >= abs(h) THEN t WHEN abs(p) >= abs(h) THEN p ELSE h END >= 0 THEN 1 ELSE -1 END AS direction FROM z""",
)
def q_candidates(spark, sf):
    z = stations(spark, sf).selectExpr("id", "(temperature - 24) / 3 AS t", "(pressure - 1008) / 6 AS p", "(humidity - 65) / 20 AS h")
    best = F.greatest(F.abs("t"), F.abs("p"), F.abs("h"))
    signed = F.when(F.abs("t") == best, c("t")).when(F.abs("p") == best, c("p")).otherwise(c("h"))
    name = F.when(F.abs("t") == best, "temperature").when(F.abs("p") == best, "pressure").otherwise("humidity")
    return z.select("id", name.alias("channel"), F.when(signed >= 0, 1).otherwise(-1).alias("direction"))


@query("MDL14_coverage", f"WITH {OBS} SELECT event_id, round(least(1.0, (row_number() OVER (PARTITION BY station_id ORDER BY observed_at, event_id)) / 72.0::DOUBLE), 6) AS temporal, round(((temperature IS NOT NULL)::INT + (pressure IS NOT NULL)::INT + (humidity IS NOT NULL)::INT) / 3.0::DOUBLE, 6) AS multivariate FROM obs")
def q_coverage(spark, sf):
    seen = F.least(F.lit(1.0), F.row_number().over(W()) / 72.0)
    share = sum(c(x).isNotNull().cast("int") for x in CH) / 3.0
    return observations(spark, sf).select("event_id", F.round(seen, 6).alias("temporal"), F.round(share, 6).alias("multivariate"))


@query("MDL22_expected_bucket", "SELECT * FROM (VALUES ('normal', 'NORMAL'), ('spike', 'ANOMALY'), ('frozen', 'ANOMALY'), ('drop', 'ANOMALY')) t(scenario_id, bucket)")
def q_buckets(spark, sf):
    """Each scenario's worst status, by the same layer that scores observations."""
    from ..sources.records import scenario_steps

    steps = scenario_steps(spark).select(
        F.xxhash64("scenario_id").alias("station_id"), "scenario_id", c("step").cast("long").alias("event_id"), "temperature",
        F.timestamp_seconds(1_700_000_000 + c("t_offset_min") * 60).alias("observed_at"),
    )
    worst = F.max("layer_score")
    return temporal_layer(steps, "temperature").groupBy("scenario_id").agg(T.status_of(worst).alias("bucket"))


_SNAP = "SELECT CAST({of} AS BIGINT) AS id, {list}(c_custkey) AS members, 10 + avg(c_custkey % 20) AS lat, 70 + avg(c_custkey % 20) AS lon, avg(c_acctbal / 1e3) AS magnitude, count(*) AS n FROM customer GROUP BY 1"


@query(
    "ST15_event_tracking",
    f"""WITH p AS ({_SNAP.format(of='floor(c_custkey / 12)', list='list')}), q AS ({_SNAP.format(of=NOW, list='list')}),
pm AS (SELECT id AS event, unnest(members) AS m FROM p), qm AS (SELECT id AS cluster, unnest(members) AS m FROM q), l AS (SELECT DISTINCT event, cluster FROM pm JOIN qm USING (m)),
j AS (SELECT *, count(*) OVER (PARTITION BY event) AS be, count(*) OVER (PARTITION BY cluster) AS bc FROM l), k AS (SELECT event, cluster, CASE WHEN be > 1 THEN 'SPLIT_AMBIGUOUS' WHEN bc > 1 THEN 'MERGE' ELSE 'CONTINUE' END AS kind FROM j)
SELECT 'E' || event AS name, 'ACTIVE' AS status, concat_ws(',', CASE WHEN 2 * 6371.0 * asin(sqrt(pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2))) > 125 THEN 'MOVING' END, CASE WHEN q.magnitude - p.magnitude >= 1 THEN 'INTENSIFYING' WHEN q.magnitude - p.magnitude <= -1 THEN 'WEAKENING' END, CASE WHEN q.n > p.n THEN 'GROWING' WHEN q.n < p.n THEN 'SHRINKING' END) AS flags FROM k JOIN p ON p.id = event JOIN q ON q.id = cluster WHERE kind = 'CONTINUE'
UNION ALL SELECT 'N' || q.id, 'NEW', coalesce((SELECT max(kind) FROM k WHERE k.cluster = q.id AND kind <> 'CONTINUE'), '') FROM q WHERE q.id NOT IN (SELECT cluster FROM k WHERE kind = 'CONTINUE')
UNION ALL SELECT 'E' || p.id, 'DISAPPEARED', '' FROM p WHERE p.id NOT IN (SELECT event FROM k WHERE kind = 'CONTINUE')""",
)
def q_tracking(spark, sf):
    def snapshot(of: str):
        return table(spark, sf, "customer").groupBy(F.expr(f"CAST({of} AS BIGINT)").alias("id")).agg(
            F.collect_set("c_custkey").alias("members"),
            (10 + F.avg(c("c_custkey") % 20)).alias("lat"),
            (70 + F.avg(c("c_custkey") % 20)).alias("lon"),
            F.avg(c("c_acctbal") / 1e3).alias("magnitude"),
        )

    return tracked(snapshot("floor(c_custkey / 12)"), snapshot(NOW))


@query(
    "JN11_cluster_extent",
    f"WITH {ST} SELECT a.nation, round(max(2 * 6371.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 4) AS extent_km FROM st a JOIN st b ON a.nation = b.nation AND a.id < b.id GROUP BY 1",
)
def q_extent(spark, sf):
    from ..operators.spatial import extents

    return extents(stations(spark, sf), "nation").select("nation", F.round("extent_km", 4).alias("extent_km"))


@query(
    "JN12_opposite_season",
    "WITH m AS (SELECT o_orderpriority AS city, month(o_orderdate) AS mo, arg_min(o_orderkey, (o_orderkey * 2654435761 % 1000, o_orderkey)) AS pick FROM orders GROUP BY ALL) SELECT o.o_orderkey, m.pick FROM orders o JOIN m ON m.city = o.o_orderpriority AND m.mo = (month(o.o_orderdate) + 5) % 12 + 1",
)
def q_season(spark, sf):
    orders = table(spark, sf, "orders")
    picks = orders.groupBy(c("o_orderpriority").alias("city"), F.month("o_orderdate").alias("mo")).agg(
        F.min_by("o_orderkey", F.struct(c("o_orderkey") * 2654435761 % 1000, "o_orderkey")).alias("pick")
    )
    some = orders.select("o_orderkey", c("o_orderpriority").alias("city"), ((F.month("o_orderdate") + 5) % 12 + 1).alias("mo"))
    return some.join(picks, ["city", "mo"]).select("o_orderkey", "pick")


@query("AGG18_leading_runs", f"WITH {OBS}, n AS (SELECT station_id, value > 30 AS hit, row_number() OVER (PARTITION BY station_id ORDER BY observed_at, event_id) AS i FROM obs), f AS (SELECT station_id, min(i) FILTER (NOT hit) AS stop, max(i) AS n FROM n GROUP BY 1) SELECT station_id, (coalesce(stop - 1, n))::INT AS leading FROM f")
def q_leading(spark, sf):
    n = observations(spark, sf).select("station_id", (c("value") > 30).alias("hit"), F.row_number().over(W()).alias("i"))
    return n.groupBy("station_id").agg(F.coalesce(F.min(F.when(~c("hit"), c("i"))) - 1, F.max("i")).alias("leading"))


@query("SRT06_canonical_numbers", f"WITH {ST}, g AS (SELECT nation, avg(lat) AS lat, avg(lon) AS lon, min(id) AS first FROM st GROUP BY nation) SELECT nation, row_number() OVER (ORDER BY round(lat, 6), round(lon, 6), first)::INT AS number FROM g")
def q_numbers(spark, sf):
    from ..operators.spatial import numbered

    g = stations(spark, sf).groupBy("nation").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.sort_array(F.collect_list("id")).alias("members"))
    return numbered(g).select("nation", "number")


@query("PRJ13_legacy_projection", f"WITH {OBS}, a AS (SELECT event_id, temperature > 35 AS t, pressure > 1030 AS p FROM obs) SELECT event_id, CASE WHEN t THEN 'temperature' WHEN p THEN 'pressure' ELSE 'humidity' END AS parameter, CASE WHEN t THEN '°C' WHEN p THEN 'hPa' ELSE '%' END AS unit FROM a")
def q_legacy(spark, sf):
    t, p = c("temperature") > 35, c("pressure") > 1030
    return observations(spark, sf).select(
        "event_id", F.when(t, "temperature").when(p, "pressure").otherwise("humidity").alias("parameter"), F.when(t, "°C").when(p, "hPa").otherwise("%").alias("unit")
    )


@query("PRJ19_EXT28_display_status", "WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS wo FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN wo = 'F' THEN 'repair done' WHEN wo = 'O' THEN 'repair open' WHEN wo IS NULL THEN CASE WHEN c_acctbal < 0 THEN 'unassigned' ELSE 'watching' END ELSE 'in progress' END AS label FROM customer LEFT JOIN l ON o_custkey = c_custkey")
def q_display(spark, sf):
    last = table(spark, sf, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("wo"))
    label = (
        F.when(c("wo") == "F", "repair done").when(c("wo") == "O", "repair open")
        .when(c("wo").isNull(), F.when(c("c_acctbal") < 0, "unassigned").otherwise("watching")).otherwise("in progress")
    )
    return table(spark, sf, "customer").join(last, "c_custkey", "left").select("c_custkey", label.alias("label"))


@query("EXT04_narrative", "SELECT o_orderkey AS incident, 0 AS stage, 'detected' AS what FROM orders UNION ALL SELECT o_orderkey, 1, 'reviewed' FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT l_orderkey, 2, l_linestatus FROM lineitem")
def q_narrative(spark, sf):
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem")
    parts = [
        orders.selectExpr("o_orderkey AS incident", "0 AS stage", "'detected' AS what"),
        orders.where("o_orderstatus <> 'O'").selectExpr("o_orderkey AS incident", "1 AS stage", "'reviewed' AS what"),
        lines.selectExpr("l_orderkey AS incident", "2 AS stage", "l_linestatus AS what"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("EXT10_summary_sentence", "SELECT event_id, 'Triggered: ' || coalesce(nullif(concat_ws(', ', CASE WHEN event_id % 2 = 0 THEN 'physics' END, CASE WHEN event_id % 3 = 0 THEN 'temporal' END, CASE WHEN event_id % 5 = 0 THEN 'spatial' END), ''), 'none') AS summary FROM events")
def q_sentence(spark, sf):
    hit = F.array_compact(F.array(*[F.when(c("event_id") % k == 0, n) for k, n in ((2, "physics"), (3, "temporal"), (5, "spatial"))]))
    text = F.concat_ws(", ", hit)
    return table(spark, sf, "events").select("event_id", F.concat(F.lit("Triggered: "), F.when(text == "", "none").otherwise(text)).alias("summary"))


@query("EXT15_synthetic_day", f"WITH {ST} SELECT id, h.range AS hour, round(temperature + 4 * sin(2 * pi() * (h.range - 9) / 24), 6) AS temperature FROM st, range(24) h")
def q_day(spark, sf):
    hours = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour")
    day = stations(spark, sf).select("id", "temperature", hours)
    return day.select("id", "hour", F.round(c("temperature") + 4 * F.sin(2 * F.pi() * (c("hour") - 9) / 24), 6).alias("temperature"))


@query("EXT19_EXT20_first_rows", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3")
def q_first_rows(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("user_id", "event_id")


@query("EXT23_side_by_side", f"WITH {OBS} SELECT event_id, CASE WHEN value > 70 THEN 1 ELSE 0 END AS rules, CASE WHEN value > 70 OR temperature > 37 THEN 1 ELSE 0 END AS integrated FROM obs")
def q_side(spark, sf):
    rule = F.coalesce(c("value") > 70, F.lit(False))
    both = rule | F.coalesce(c("temperature") > 37, F.lit(False))
    return observations(spark, sf).select("event_id", rule.cast("int").alias("rules"), both.cast("int").alias("integrated"))


@query("EXT27_demo_payloads", "SELECT range AS tick, 24.0::DOUBLE + range % 3 + CASE WHEN range % 4 = 0 THEN 15 ELSE 0 END AS temperature FROM range(100)")
def q_demo(spark, sf):
    tick = c("id")
    return spark.range(100).select(tick.alias("tick"), (24.0 + tick % 3 + F.when(tick % 4 == 0, 15).otherwise(0)).alias("temperature"))


_TEN = ["ingest", "normalise", "quality", "physics", "temporal", "multivariate", "spatial", "drift", "fusion", "diagnosis"]
_MISSING = "(temperature IS NULL)::INT + (pressure IS NULL)::INT + (humidity IS NULL)::INT"


@query(
    "EXT31_pipeline_stages",
    f"""WITH {OBS}, a AS (SELECT event_id, {_MISSING} AS m, value FROM obs), s AS (SELECT event_id, m, value, unnest({_TEN}) AS stage, unnest(range(1, 11)) AS number FROM a)
SELECT event_id, number::INT AS number, stage, CASE WHEN m = 3 AND number > 2 THEN 'SKIPPED' WHEN number = 3 AND m > 0 THEN 'DEGRADED' WHEN number = 5 AND value > 70 THEN 'TRIGGERED' ELSE 'OK' END AS state FROM s""",
)
def q_stages(spark, sf):
    missing = sum((c(x).isNull().cast("int") for x in CH), F.lit(0))
    at = observations(spark, sf).select("event_id", missing.alias("m"), "value", F.posexplode(F.array(*[F.lit(x) for x in _TEN])).alias("i", "stage"))
    number = c("i") + 1
    state = (
        F.when((c("m") == 3) & (number > 2), "SKIPPED").when((number == 3) & (c("m") > 0), "DEGRADED")
        .when((number == 5) & (c("value") > 70), "TRIGGERED").otherwise("OK")
    )
    return at.select("event_id", number.alias("number"), "stage", state.alias("state"))


@query("EXT32_drift_reference", f"WITH {OBS} SELECT event_id, CASE WHEN temperature IS NOT NULL THEN 'SPATIAL' WHEN pressure IS NOT NULL THEN 'BACKGROUND' ELSE 'RAW' END AS mode, coalesce(temperature, pressure, value) AS reference FROM obs")
def q_mode(spark, sf):
    mode = F.when(c("temperature").isNotNull(), "SPATIAL").when(c("pressure").isNotNull(), "BACKGROUND").otherwise("RAW")
    return observations(spark, sf).select("event_id", mode.alias("mode"), F.coalesce("temperature", "pressure", "value").alias("reference"))


@query("EXT34_layer_agreement", "SELECT event_id, ((event_id % 2 = 0)::INT + (event_id % 3 = 0)::INT + (event_id % 5 = 0)::INT + (event_id % 7 = 0)::INT) AS agreeing FROM events")
def q_agreement(spark, sf):
    flags = F.array(*[c("event_id") % k == 0 for k in (2, 3, 5, 7)])
    return table(spark, sf, "events").select("event_id", F.size(F.filter(flags, lambda x: x)).alias("agreeing"))
