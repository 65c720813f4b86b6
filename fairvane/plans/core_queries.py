"""Queries for normalisation, filters, scalar functions and per-station windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import normalise as N
from ..operators import temporal as T
from .registry import query
from .stand_ins import OBSERVATIONS_SQL as OBS
from .stand_ins import STATIONS_SQL as ST
from .stand_ins import observations, stations, table

W = T.ordered
OVER = "(PARTITION BY station_id ORDER BY observed_at, event_id)"


def c(name: str):
    return F.col(name)


def r6(x):
    return F.round(x, 6)


def _flagship_sql(channel: str = "temperature", step: float = 3.5, floor: float = 0.2) -> str:
    return f"""WITH {OBS},
a AS (SELECT *, abs({channel} - lag({channel}) OVER w) AS d,
  greatest(1.0, abs(epoch_us(observed_at) - epoch_us(lag(observed_at) OVER w)) / 1e6) AS gap,
  CASE WHEN abs({channel} - lag({channel}) OVER w) < 1e-6 THEN 0 ELSE 1 END AS changed
  FROM obs WINDOW w AS {OVER}),
b AS (SELECT *, {step} * greatest(0.5, least(3.0, gap / 600)) AS lim,
  sum(changed) OVER (PARTITION BY station_id ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
e AS (SELECT *, least(row_number() OVER r, 72) AS run_length,
  (epoch_us(observed_at) - epoch_us(first_value(observed_at) OVER (PARTITION BY station_id, run ORDER BY observed_at, event_id ROWS 71 PRECEDING))) / 1e6 / 60 AS minutes
  FROM b WINDOW r AS (PARTITION BY station_id, run ORDER BY observed_at, event_id)),
f AS (SELECT *, median({channel}) OVER h AS med, list({channel}) FILTER ({channel} IS NOT NULL) OVER h AS hist FROM e
  WINDOW h AS (PARTITION BY station_id ORDER BY observed_at, event_id ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, list_median(list_transform(hist, lambda x: abs(x - med))) AS mad FROM f),
i AS (SELECT *, CASE WHEN len(hist) >= 24 AND {channel} IS NOT NULL
   AND (mad > 1e-3 OR len(list_distinct(list_transform(hist, lambda x: round(x, 6)))) > 1)
   THEN 0.6745 * abs({channel} - med) / greatest(mad, {floor}) END AS z FROM g),
s AS (SELECT event_id, station_id,
  CASE WHEN d > lim THEN least(1.0, d / (1.8 * lim)) ELSE 0.0 END AS step,
  CASE WHEN run_length >= 12 AND minutes >= 60 AND {channel} IS NOT NULL THEN 0.95 ELSE 0.0 END AS frozen,
  CASE WHEN z > 3.5 THEN least(1.0, (z - 3.5) / 3 + 0.6) ELSE 0.0 END AS zs FROM i)
SELECT event_id, station_id, round(step::DOUBLE, 6) AS step_score, frozen::DOUBLE AS frozen_score, round(zs::DOUBLE, 6) AS z_score,
  CASE WHEN greatest(step, frozen, zs) >= 0.7 THEN 'ANOMALY' WHEN greatest(step, frozen, zs) >= 0.4 THEN 'WARNING' ELSE 'NORMAL' END AS status
FROM s"""


def temporal_layer(obs: DataFrame, channel: str) -> DataFrame:
    """Step, frozen and z scores of one channel with their worst, in one exchange."""
    out = T.with_modified_z(T.with_frozen(obs.withColumn("step_score", T.step_score(channel, c(channel), c("observed_at"), W())), channel, W()), channel, W())
    worst = F.greatest("step_score", "frozen_score", "z_score")
    return out.withColumn("layer_score", worst).withColumn("status", T.status_of(worst))


@query("Q01_temporal_layer", _flagship_sql())
def q_temporal(spark: SparkSession, sf: str) -> DataFrame:
    out = temporal_layer(observations(spark, sf), "temperature")
    return out.select("event_id", "station_id", r6("step_score").alias("step_score"), "frozen_score", r6("z_score").alias("z_score"), "status")


@query(
    "WIN01_step_rate",
    f"""WITH {OBS}, a AS (SELECT event_id, abs(pressure - lag(pressure) OVER w) AS d,
  greatest(1.0, abs(epoch_us(observed_at) - epoch_us(lag(observed_at) OVER w)) / 1e6) AS gap FROM obs WINDOW w AS {OVER}),
b AS (SELECT *, 2.5 * greatest(0.5, least(3.0, gap / 600)) AS lim FROM a)
SELECT event_id, round((CASE WHEN d > lim THEN least(1.0, d / (1.8 * lim)) ELSE 0.0 END)::DOUBLE, 6) AS score FROM b""",
)
def q_step(spark, sf):
    return observations(spark, sf).select("event_id", r6(T.step_score("pressure", c("pressure"), c("observed_at"), W())).alias("score"))


@query(
    "WIN05_recent_peak",
    f"WITH {OBS} SELECT event_id, max(value) OVER (PARTITION BY station_id ORDER BY observed_at, event_id ROWS 5 PRECEDING) AS peak FROM obs",
)
def q_peak(spark, sf):
    return observations(spark, sf).select("event_id", T.recent_peak(c("value"), W()).alias("peak"))


@query(
    "WIN06_sessions",
    f"""WITH {OBS}, a AS (SELECT *, (epoch_us(observed_at) - epoch_us(lag(observed_at) OVER {OVER})) / 60e6 AS gap FROM obs),
b AS (SELECT *, sum(CASE WHEN gap > 720 OR gap <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING) AS session FROM a)
SELECT event_id, session::BIGINT AS session, row_number() OVER (PARTITION BY station_id, session ORDER BY observed_at, event_id)::BIGINT AS position FROM b""",
)
def q_sessions(spark, sf):
    out = T.with_sessions(observations(spark, sf), W(), max_gap_min=720.0)
    return out.select("event_id", c("session").cast("long").alias("session"), c("position").cast("long").alias("position"))


@query(
    "WIN09_trend",
    f"""WITH {OBS} SELECT event_id, round((CASE WHEN count(value) OVER h >= 12 THEN regr_slope(value, epoch_us(observed_at) / 864e8) OVER h END)::DOUBLE, 5) AS slope FROM obs
WINDOW h AS (PARTITION BY station_id ORDER BY observed_at, event_id ROWS 143 PRECEDING)""",
)
def q_trend(spark, sf):
    days = T.seconds(c("observed_at")) / 86400
    return observations(spark, sf).select("event_id", F.round(T.trend(c("value"), days, W()), 5).alias("slope"))


@query(
    "WIN11_bias",
    f"WITH {OBS} SELECT event_id, round(avg(value) OVER (PARTITION BY station_id ORDER BY observed_at, event_id ROWS 11 PRECEDING), 6) AS bias FROM obs",
)
def q_bias(spark, sf):
    return observations(spark, sf).select("event_id", r6(F.avg("value").over(W().rowsBetween(-11, 0))).alias("bias"))


@query(
    "WIN13_time_of_day",
    f"""WITH {OBS} SELECT event_id, round(sin(2 * pi() * (hour(observed_at) + minute(observed_at) / 60.0::DOUBLE) / 24), 6) AS sin_t,
round(cos(2 * pi() * (hour(observed_at) + minute(observed_at) / 60.0::DOUBLE) / 24), 6) AS cos_t FROM obs""",
)
def q_daypart(spark, sf):
    s, k = T.day_part(c("observed_at"))
    return observations(spark, sf).select("event_id", r6(s).alias("sin_t"), r6(k).alias("cos_t"))


@query(
    "WIN14_sliding_windows",
    f"""WITH {OBS}, a AS (SELECT event_id, row_number() OVER {OVER} AS rn, list(value) OVER (PARTITION BY station_id ORDER BY observed_at, event_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS w FROM obs)
SELECT event_id, len(w)::BIGINT AS n, round(list_sum(w), 4) AS total FROM a WHERE len(w) = 24 AND (rn - 1 - 24) % 6 = 0""",
)
def q_sliding(spark, sf):
    out = T.sliding_windows(observations(spark, sf), "value", W(), 24, 6)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return out.select("event_id", F.size("window").cast("long").alias("n"), F.round(total, 4).alias("total"))


@query(
    "WIN15_streaks",
    f"""WITH {OBS}, a AS (SELECT *, value > 60 AS hit, sum(CASE WHEN value > 60 THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING) AS blk FROM obs)
SELECT event_id, (CASE WHEN hit THEN sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, blk ORDER BY observed_at, event_id) ELSE 0 END)::BIGINT AS streak FROM a""",
)
def q_streak(spark, sf):
    return T.with_streak(observations(spark, sf), c("value") > 60, W()).select("event_id", c("streak").cast("long").alias("streak"))


@query(
    "WIN16_rolling_median",
    f"""WITH {OBS} SELECT event_id, CASE WHEN count(value) OVER h >= 3 THEN median(value) OVER h END AS baseline FROM obs
WINDOW h AS (PARTITION BY station_id ORDER BY observed_at, event_id ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING)""",
)
def q_rolling(spark, sf):
    return observations(spark, sf).select("event_id", T.rolling_median(c("value"), W()).alias("baseline"))


@query(
    "WIN17_recovery",
    f"""WITH {OBS} SELECT event_id, (count(value) OVER h = 6 AND max(value) OVER h < 90) AS stays FROM obs
WINDOW h AS (PARTITION BY station_id ORDER BY observed_at, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)""",
)
def q_recovery(spark, sf):
    return observations(spark, sf).select("event_id", T.stays_below(c("value"), W(), 6, 90.0).alias("stays"))


@query(
    "WIN18_noise_scale",
    f"""WITH {OBS}, a AS (SELECT *, value - lag(value) OVER {OVER} AS d FROM obs)
SELECT event_id, round(stddev_samp(d) OVER (PARTITION BY station_id ORDER BY observed_at, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 6) AS noise FROM a""",
)
def q_noise(spark, sf):
    diffs = observations(spark, sf).withColumn("d", c("value") - F.lag("value").over(W()))
    return diffs.select("event_id", r6(T.noise_scale(c("d"), W())).alias("noise"))


@query(
    "WIN19_autocorrelation",
    f"""WITH {OBS}, a AS (SELECT station_id, value, lag(value) OVER {OVER} AS p FROM obs)
SELECT station_id, round(corr(value, p), 6) AS r1 FROM a GROUP BY station_id""",
)
def q_autocorr(spark, sf):
    lagged = observations(spark, sf).select("station_id", "value", F.lag("value").over(W()).alias("p"))
    return lagged.groupBy("station_id").agg(r6(F.corr("value", "p")).alias("r1"))


@query(
    "EXT21_longest_run",
    f"""WITH {OBS}, a AS (SELECT *, sum(CASE WHEN value > 40 THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING) AS blk FROM obs),
b AS (SELECT station_id, blk, count(*) FILTER (value > 40) AS n FROM a GROUP BY ALL)
SELECT station_id, max(n)::BIGINT AS longest FROM b GROUP BY station_id""",
)
def q_longest(spark, sf):
    return T.longest_run(observations(spark, sf), c("value") > 40, W()).select("station_id", c("longest").cast("long").alias("longest"))


_UNIT = "CASE event_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'F' WHEN 2 THEN 'K' ELSE 'psi' END"


@query(
    "PRJ01_units",
    f"""WITH {OBS}, a AS (SELECT *, {_UNIT} AS unit FROM obs)
SELECT event_id, round((CASE unit WHEN 'C' THEN value WHEN 'F' THEN value * (5::DOUBLE / 9) - 160::DOUBLE / 9 WHEN 'K' THEN value - 273.15 END)::DOUBLE, 6) AS celsius,
CASE WHEN unit IN ('C', 'F', 'K', 'C10') THEN NULL ELSE 'UNSUPPORTED_UNIT' END AS reject,
round((wind_speed * 1.609344)::DOUBLE, 6) AS wind_kmh FROM a""",
)
def q_units(spark, sf):
    obs = observations(spark, sf).withColumn("unit", F.expr(_UNIT))
    return obs.select(
        "event_id",
        r6(N.converted("temperature", c("value"), c("unit"))).alias("celsius"),
        F.when(~N.unit_known("temperature", c("unit")), "UNSUPPORTED_UNIT").alias("reject"),
        r6(N.converted("wind_speed", c("wind_speed"), F.lit("mph"))).alias("wind_kmh"),
    )


@query(
    "PRJ02_observation_id",
    f"""WITH {OBS} SELECT event_id, 'obs_' || substr(sha1(station_id::VARCHAR || '|' || source || '|' || strftime(observed_at, '%Y-%m-%dT%H:%M:%S') || '+00:00'), 1, 20) AS observation_id FROM obs""",
)
def q_obs_id(spark, sf):
    made = N.observation_id(c("station_id").cast("string"), c("source"), c("observed_at"))
    return observations(spark, sf).select("event_id", made.alias("observation_id"))


@query(
    "PRJ03_quality_flags",
    f"""WITH {OBS} SELECT event_id, array_to_string(list_filter([
 CASE WHEN temperature IS NULL THEN 'MISSING_TEMPERATURE' END, CASE WHEN pressure IS NULL THEN 'MISSING_PRESSURE' END,
 CASE WHEN humidity IS NULL THEN 'MISSING_HUMIDITY' END,
 CASE WHEN temperature IS NULL AND pressure IS NULL AND humidity IS NULL THEN 'NO_CORE_CHANNELS' END,
 CASE WHEN event_id % 12 > 6 THEN 'LATE_ARRIVAL' END], lambda x: x IS NOT NULL), ',') AS flags FROM obs""",
)
def q_flags(spark, sf):
    obs = observations(spark, sf).withColumn("received_at", F.expr("observed_at + make_dt_interval(0, cast(event_id % 12 as int), 0, 0)"))
    core = ("temperature", "pressure", "humidity")
    flags = N.quality_flags({n: c(n) for n in core}, c("observed_at"), c("received_at"), core)
    return obs.select("event_id", F.concat_ws(",", flags).alias("flags"))


@query(
    "PRJ04_channel_quality",
    f"""WITH {OBS}, a AS (SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 0.0 ELSE pressure END AS p, CASE WHEN event_id % 37 = 0 THEN humidity - 120 WHEN event_id % 41 = 0 THEN humidity + 100 ELSE humidity END AS h FROM obs)
SELECT event_id, CASE WHEN p IS NULL THEN 'missing' WHEN p < 1 THEN 'zero_substituted' ELSE 'valid' END AS pressure_quality, CASE WHEN p >= 1 THEN p END AS pressure,
CASE WHEN h IS NULL THEN 'missing' WHEN h < 0 THEN 'invalid' WHEN h > 100 THEN 'out_of_range' ELSE 'valid' END AS humidity_quality, CASE WHEN h >= 0 THEN round(h, 6) END AS humidity FROM a""",
)
def q_quality(spark, sf):
    p = F.when(c("event_id") % 31 == 0, 0.0).otherwise(c("pressure"))
    h = F.when(c("event_id") % 37 == 0, c("humidity") - 120).when(c("event_id") % 41 == 0, c("humidity") + 100).otherwise(c("humidity"))
    return observations(spark, sf).select(
        "event_id",
        N.channel_quality("pressure", p).alias("pressure_quality"),
        N.channel_value("pressure", p).alias("pressure"),
        N.channel_quality("humidity", h).alias("humidity_quality"),
        r6(N.channel_value("humidity", h)).alias("humidity"),
    )


@query(
    "PRJ05_freshness",
    f"""WITH {OBS}, a AS (SELECT event_id, value, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id * 71 % 4000) - 400 END AS age FROM obs)
SELECT event_id, CASE WHEN value IS NULL THEN 'MISSING' WHEN age IS NULL OR age < 0 THEN 'UNKNOWN' WHEN age <= 900 THEN 'LIVE' ELSE 'STALE' END AS freshness FROM a""",
)
def q_fresh(spark, sf):
    age = F.when(c("event_id") % 9 != 0, c("event_id") * 71 % 4000 - 400)
    return observations(spark, sf).select("event_id", N.freshness(c("value").isNotNull(), age, 900.0).alias("freshness"))


@query(
    "PRJ06_effective_time",
    f"WITH {OBS} SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN observed_at END, TIMESTAMP '2024-02-01 00:00:00') AS effective_at FROM obs",
)
def q_effective(spark, sf):
    seen = F.when(c("event_id") % 3 > 0, c("observed_at"))
    return observations(spark, sf).select("event_id", F.coalesce(seen, F.expr("timestamp_ntz'2024-02-01 00:00:00'")).alias("effective_at"))


@query(
    "PRJ07_plausible",
    f"WITH {OBS} SELECT event_id, CASE WHEN temperature BETWEEN 15 AND 35 THEN temperature END AS temperature, CASE WHEN pressure BETWEEN 1000 AND 1030 THEN pressure END AS pressure FROM obs",
)
def q_plausible(spark, sf):
    return observations(spark, sf).select(
        "event_id",
        N.plausible(c("temperature"), 15, 35).alias("temperature"),
        N.plausible(c("pressure"), 1000, 1030).alias("pressure"),
    )


@query(
    "PRJ08_pressure_selection",
    f"""WITH {OBS}, a AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 WHEN event_id % 5 = 0 THEN NULL ELSE pressure END AS msl, CASE WHEN event_id % 4 = 0 THEN NULL ELSE pressure - 10 END AS sfc FROM obs)
SELECT event_id, round(coalesce(nullif(msl, 0), nullif(sfc, 0)), 6) AS pressure, CASE WHEN nullif(msl, 0) IS NOT NULL THEN 'MSL' WHEN nullif(sfc, 0) IS NOT NULL THEN 'SURFACE' END AS convention FROM a""",
)
def q_pressure(spark, sf):
    msl = F.when(c("event_id") % 3 == 0, 0.0).when(c("event_id") % 5 == 0, None).otherwise(c("pressure"))
    value, kind = N.selected_pressure(msl, F.when(c("event_id") % 4 != 0, c("pressure") - 10))
    return observations(spark, sf).select("event_id", r6(value).alias("pressure"), kind.alias("convention"))


@query(
    "PRJ09_cardinal",
    f"""WITH {OBS} SELECT event_id, CASE WHEN wind_direction IS NULL THEN 'CALM' ELSE
['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][(floor(wind_direction / 22.5 + 0.5)::INT % 16) + 1] END AS cardinal FROM obs""",
)
def q_cardinal(spark, sf):
    return observations(spark, sf).select("event_id", P.cardinal(c("wind_direction")).alias("cardinal"))


WMO = {0: "Clear", 1: "Mainly clear", 2: "Partly cloudy", 3: "Overcast", 45: "Fog", 61: "Light rain", 63: "Rain", 95: "Thunderstorm"}


@query(
    "PRJ10_weather_text",
    f"WITH {OBS} SELECT event_id, coalesce(CASE (event_id % 100) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in WMO.items()) + " END, 'Fair') AS weather FROM obs",
)
def q_wmo(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in WMO.items() for x in kv])
    found = F.try_element_at(names, (c("event_id") % 100).cast("int"))
    return observations(spark, sf).select("event_id", F.coalesce(found, F.lit("Fair")).alias("weather"))


@query(
    "PRJ11_observed_minus_reference",
    f"""WITH {OBS}, ref AS (SELECT n_nationkey AS k, 15.0::DOUBLE + n_nationkey AS t, n_nationkey % 6 AS age_h FROM nation)
SELECT event_id, round(temperature - t, 6) AS delta, age_h > 3 AS stale FROM obs LEFT JOIN ref ON station_id % 30 = k""",
)
def q_reference(spark, sf):
    nation = F.col("n_nationkey")
    ref = table(spark, sf, "nation").select(nation.cast("long").alias("k"), (15.0 + nation).alias("t"), (nation % 6).alias("age_h"))
    met = observations(spark, sf).withColumn("k", c("station_id") % 30).join(ref, "k", "left")
    return met.select("event_id", r6(c("temperature") - c("t")).alias("delta"), (c("age_h") > 3).alias("stale"))


@query(
    "PRJ12_severity_labels",
    f"""WITH {OBS}, a AS (SELECT event_id, (event_id % 101)::DOUBLE / 100 AS s FROM obs), b AS (SELECT *, CASE WHEN s >= 0.75 THEN 'HIGH' WHEN s >= 0.45 THEN 'WARNING' WHEN s > 0 THEN 'LOW' ELSE 'NONE' END AS label FROM a)
SELECT event_id, label, CASE WHEN label = 'HIGH' THEN 'CRITICAL' WHEN label IN ('LOW', 'NONE') THEN 'INFO' ELSE 'WARNING' END AS incident FROM b""",
)
def q_severity(spark, sf):
    label = N.severity_label((c("event_id") % 101).cast("double") / 100)
    return observations(spark, sf).select("event_id", label.alias("label"), N.incident_severity(label).alias("incident"))


@query(
    "FLT01_future_reject",
    f"WITH {OBS} SELECT event_id, (event_id * 7 % 30) - 15 > 5 AS rejected FROM obs",
)
def q_future(spark, sf):
    obs = observations(spark, sf).withColumn("received_at", F.expr("observed_at - make_dt_interval(0, 0, cast(event_id * 7 % 30 as int) - 15, 0)"))
    return obs.select("event_id", N.from_future(c("observed_at"), c("received_at")).alias("rejected"))


@query(
    "FLT02_corrupt_values",
    """SELECT event_id, try_cast(raw AS DOUBLE) IS NOT NULL AND NOT isnan(try_cast(raw AS DOUBLE)) AND abs(try_cast(raw AS DOUBLE)) <= 1e5 AS usable,
regexp_full_match(name, '[A-Za-z0-9_.:\\-]{1,64}') AS id_ok FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN '1e9' WHEN 2 THEN 'x' ELSE CAST(round(value, 2) AS VARCHAR) END AS raw,
'st' || CASE WHEN event_id % 6 = 0 THEN ' ' ELSE ':' END || event_id AS name FROM events)""",
)
def q_corrupt(spark, sf):
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN '1e9' WHEN 2 THEN 'x' ELSE CAST(round(value, 2) AS STRING) END")
    name = F.expr("concat('st', CASE WHEN event_id % 6 = 0 THEN ' ' ELSE ':' END, event_id)")
    value = raw.try_cast("double")
    return table(spark, sf, "events").select(
        "event_id", N.usable(value).alias("usable"), name.rlike(r"^[A-Za-z0-9_.:\-]{1,64}$").alias("id_ok")
    )


@query(
    "FLT03_unknown_station",
    "SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)",
)
def q_unknown(spark, sf):
    known = table(spark, sf, "customer").where("c_custkey % 3 > 0").select(c("c_custkey").alias("user_id"))
    return table(spark, sf, "events").join(known, "user_id", "left_anti").select("event_id")


@query(
    "FLT04_bounding_box",
    f"WITH {ST} SELECT id FROM st WHERE lat BETWEEN 10 AND 25 AND lon BETWEEN 72 AND 85 AND source = 'AWS_IN_SITU' ORDER BY id LIMIT 100",
)
def q_box(spark, sf):
    near = stations(spark, sf).where(c("lat").between(10, 25) & c("lon").between(72, 85) & (c("source") == "AWS_IN_SITU"))
    return near.select("id").orderBy("id").limit(100)


@query(
    "FLT05_search",
    f"WITH {ST} SELECT id, name FROM st WHERE contains(lower(name), '07') OR contains(lower(segment), 'auto') ORDER BY id LIMIT 10",
)
def q_search(spark, sf):
    hit = F.lower("name").contains("07") | F.lower("segment").contains("auto")
    return stations(spark, sf).where(hit).select("id", "name").orderBy("id").limit(10)


@query(
    "FLT06_coordinates",
    f"WITH {ST}, a AS (SELECT id, CASE WHEN id % 50 = 0 THEN 0.0 WHEN id % 51 = 0 THEN 95.0 ELSE lat END AS lat, CASE WHEN id % 50 = 0 THEN 0.0 ELSE lon END AS lon FROM st) SELECT id, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0) AS ok FROM a",
)
def q_coords(spark, sf):
    lat = F.when(c("id") % 50 == 0, 0.0).when(c("id") % 51 == 0, 95.0).otherwise(c("lat"))
    return stations(spark, sf).select("id", N.valid_coordinates(lat, F.when(c("id") % 50 == 0, 0.0).otherwise(c("lon"))).alias("ok"))


@query(
    "FLT08_dataset_validity",
    f"""WITH {OBS}, a AS (SELECT CASE WHEN temperature IS NULL OR humidity IS NULL OR pressure IS NULL THEN 'null' WHEN temperature + event_id % 40 NOT BETWEEN -50 AND 60 THEN 'temperature'
WHEN humidity + event_id % 11 NOT BETWEEN 0 AND 100 THEN 'humidity' WHEN pressure NOT BETWEEN 300 AND 1100 THEN 'pressure' END AS cause FROM obs) SELECT coalesce(cause, 'valid') AS cause, count(*) AS n FROM a GROUP BY 1""",
)
def q_validity(spark, sf):
    cause = N.reject_cause(c("temperature") + c("event_id") % 40, c("humidity") + c("event_id") % 11, c("pressure"))
    return observations(spark, sf).groupBy(F.coalesce(cause, F.lit("valid")).alias("cause")).agg(F.count("*").alias("n"))


_HAV = "2 * 6371.0 * atan2(sqrt(a), sqrt(greatest(0.0, 1 - a)))"


@query(
    "FN01_haversine",
    f"""WITH {ST}, a AS (SELECT id, pow(sin(radians(lat - 20) / 2), 2) + cos(radians(20)) * cos(radians(lat)) * pow(sin(radians(lon - 80) / 2), 2) AS a FROM st)
SELECT id, round({_HAV}, 6) AS km, round(2 * 6371.0088 * asin(sqrt(least(1.0, a))), 6) AS reference_km FROM a""",
)
def q_haversine(spark, sf):
    args = (F.lit(20.0), F.lit(80.0), c("lat"), c("lon"))
    return stations(spark, sf).select("id", r6(P.haversine_km(*args)).alias("km"), r6(P.reference_distance_km(*args)).alias("reference_km"))


@query(
    "FN02_FN04_humidity",
    f"""WITH {OBS}, a AS (SELECT event_id, temperature t, humidity h, 17.27 * temperature / (237.7 + temperature) + CASE WHEN humidity IS NOT NULL THEN ln(greatest(0.01, least(100.0, humidity)) / 100) END AS g,
ln(humidity / 100) + 17.62 * temperature / (243.12 + temperature) AS g2 FROM obs)
SELECT event_id, round(237.7 * g / (17.27 - g), 5) AS dew, CASE WHEN h > 0 AND h <= 100 THEN round(243.12 * g2 / (17.62 - g2), 5) END AS display_dew,
round(CASE WHEN t IS NOT NULL THEN greatest(0.0, least(100.0, 100 * exp(17.625 * (t - 3) / (243.04 + t - 3)) / exp(17.625 * t / (243.04 + t)))) END, 5) AS humidity FROM a""",
)
def q_dew(spark, sf):
    t, h = c("temperature"), c("humidity")
    r5 = lambda x: F.round(x, 5)
    return observations(spark, sf).select(
        "event_id",
        r5(P.dew_point(t, h)).alias("dew"),
        r5(P.display_dew_point(t, h)).alias("display_dew"),
        r5(P.humidity_from_dew_point(t, t - 3)).alias("humidity"),
    )


@query(
    "FN05_FN06_pressure_height",
    f"""WITH {ST}, k AS (SELECT 9.80665 * 0.0289644::DOUBLE / (8.31447::DOUBLE * 0.0065) AS e), a AS (SELECT id, pressure p, elevation h, temperature t, e, 1013.25 * pow(1 - 0.0065::DOUBLE * elevation / 288.15, e) AS x FROM st, k)
SELECT id, CASE WHEN h > 50 AND abs(p - x) / x * 100 > 8 THEN 0.85 ELSE 0.0 END::DOUBLE AS score, round(p * pow(1 + 0.0065::DOUBLE * h / (t + 273.15), e), 4) AS msl,
round(greatest(0.0, (1 - pow(p / 1013.25, 1 / e)) * 288.15 / 0.0065), 3) AS proxy FROM a""",
)
def q_heights(spark, sf):
    p, h = c("pressure"), c("elevation")
    return stations(spark, sf).select(
        "id",
        P.hypsometric_score(p, h).alias("score"),
        F.round(P.to_sea_level(p, h, c("temperature")), 4).alias("msl"),
        F.round(P.elevation_proxy(p), 3).alias("proxy"),
    )


@query(
    "FN08_evidence_map",
    f"""WITH {OBS} SELECT event_id, round((CASE WHEN value <= 20 THEN 0.0 WHEN value >= 120 THEN 1.0 WHEN value <= 60 THEN (value - 20) / 40 * 0.5 ELSE 0.5 + (value - 60) / 60 * 0.5 END)::DOUBLE, 6) AS evidence FROM obs""",
)
def q_evidence(spark, sf):
    return observations(spark, sf).select("event_id", r6(P.evidence(c("value"), 20, 60, 120)).alias("evidence"))


@query(
    "FN11_physics_ladder",
    f"""WITH {OBS} SELECT event_id, CASE WHEN humidity < 0 OR humidity > 100 THEN 'RH_BOUNDS' WHEN temperature NOT BETWEEN -45 AND 38 THEN 'T_BOUNDS' WHEN pressure NOT BETWEEN 992 AND 1065 THEN 'P_BOUNDS'
WHEN wind_speed >= 100 THEN 'STORM' WHEN wind_speed >= 75 THEN 'GALE' ELSE 'OK' END AS rule FROM obs""",
)
def q_ladder(spark, sf):
    from ..operators.fusion import physics_rule

    rule = physics_rule(c("temperature"), c("humidity"), c("pressure"), c("wind_speed"), (-45, 38), (992, 1065))
    return observations(spark, sf).select("event_id", rule.alias("rule"))


@query(
    "FN12_FN13_scores",
    f"""WITH {OBS}, a AS (SELECT event_id, value / 20 AS z, event_id % 8 AS n, temperature t, humidity h FROM obs)
SELECT event_id, (CASE WHEN t > 32 AND h > 95 THEN 0.85 ELSE 0.0 END)::DOUBLE AS clausius, round((CASE WHEN z > 3 THEN least(least(1.0, (z - 3) / 3 + 0.5), CASE WHEN n >= 5 THEN 1.0 WHEN n >= 3 THEN 0.75 ELSE 0.5 END) ELSE 0.0 END)::DOUBLE, 6) AS spatial FROM a""",
)
def q_scores(spark, sf):
    return observations(spark, sf).select(
        "event_id",
        P.clausius_score(c("temperature"), c("humidity")).alias("clausius"),
        r6(P.spatial_raw_score(c("value") / 20, c("event_id") % 8)).alias("spatial"),
    )


@query(
    "JN04_latest_per_station",
    f"WITH {OBS} SELECT station_id, observed_at, event_id, value FROM obs QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC, event_id DESC) = 1",
)
def q_latest(spark, sf):
    obs = observations(spark, sf).select("station_id", "observed_at", "event_id", "value")
    return N.latest_by(obs, ["station_id"], ["observed_at", "event_id"])


@query(
    "SNK01_idempotent_append",
    "SELECT event_id, value FROM events WHERE event_id % 3 > 0",
)
def q_append(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    twice = events.unionByName(events.where("event_id % 10 = 1"))
    return N.new_rows(twice, events.where("event_id % 3 = 0"), "event_id")
