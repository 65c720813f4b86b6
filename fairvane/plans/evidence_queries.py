"""Queries for shown evidence, calibration, disturbed and made-up readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as K
from ..operators import evidence as V
from ..operators import multivariate as M
from ..operators import synthetic as Y
from .registry import query
from .stand_ins import OBSERVATIONS_SQL as OBS
from .stand_ins import STATIONS_SQL as ST
from .stand_ins import observations, stations, table

c = F.col

#: Cards of the five layers of an observation, in SQL that both engines read.
_CARDS = {
    "L1": "CASE WHEN temperature > 37 THEN 'VETO' WHEN temperature IS NULL THEN 'UNAVAILABLE' ELSE 'PASS' END",
    "L2": "CASE WHEN value > 90 THEN 'WARNING' WHEN event_id % 6 = 0 THEN 'INSUFFICIENT_DATA' ELSE 'PASS' END",
    "L3": "CASE WHEN pressure > 1035 THEN 'ANOMALY' WHEN event_id % 10 = 3 THEN 'INSUFFICIENT_DATA' ELSE 'PASS' END",
    "L4": "CASE WHEN event_id % 4 = 1 THEN 'NOT_APPLICABLE' WHEN humidity > 100 THEN 'ANOMALY' ELSE 'PASS' END",
    "L5": "CASE WHEN event_id % 9 = 8 THEN NULL WHEN event_id % 31 = 0 THEN 'strange' ELSE 'LIMITED' END",
}
_CARDS["L5"] = "CASE WHEN event_id % 5 < 3 THEN 'PASS' ELSE " + _CARDS["L5"] + " END"
_AVAILABLE = "event_id % 13 > 0"
_BACKEND = "CASE WHEN temperature > 37 THEN 'ANOMALY' WHEN value > 90 THEN 'warning' WHEN event_id % 37 = 0 THEN 'OFFLINE' ELSE 'NORMAL' END"
_DIAGNOSIS = "CASE WHEN event_id % 41 = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NOMINAL' END"
_IN_SITU = "source <> 'error'"
_LAYERS_SQL = f"cards AS (SELECT *, {', '.join(f'{x} AS {k}' for k, x in _CARDS.items())}, {_AVAILABLE} AS avail FROM obs)"
_STATE_SQL = (
    "CASE WHEN {0} IS NULL OR {0} = 'UNAVAILABLE' OR {0} = 'strange' AND avail THEN 'UNAVAILABLE' WHEN {0} = 'NOT_APPLICABLE' THEN {0} "
    "WHEN NOT avail OR {0} IN ('INSUFFICIENT_DATA', 'LIMITED') THEN 'INSUFFICIENT' WHEN {0} = 'VETO' THEN 'ANOMALY' ELSE {0} END"
)
_DONE = "concat_ws(', ', " + ", ".join(f"CASE WHEN s{k} IN ('PASS','WARNING','ANOMALY') THEN '{n}' END" for k, n in V.LAYER_NAMES.items()) + ")"
_LEFT = "concat_ws(', ', " + ", ".join(f"CASE WHEN s{k} NOT IN ('PASS','WARNING','ANOMALY') THEN '{n}' END" for k, n in V.LAYER_NAMES.items()) + ")"
_COUNT = " + ".join(f"(s{k} IN ('PASS','WARNING','ANOMALY'))::INT" for k in _CARDS)


def _cards(spark, sf):
    obs = observations(spark, sf)
    return obs.select("*", *[F.expr(x).alias(k) for k, x in _CARDS.items()], F.expr(_AVAILABLE).alias("avail"))


@query(
    "PRJ19_evidence_display",
    f"""WITH {OBS}, {_LAYERS_SQL}, states AS (SELECT *, {', '.join(f'{_STATE_SQL.format(k)} AS s{k}' for k in _CARDS)} FROM cards),
n AS (SELECT *, {_COUNT} AS n, {_DONE} AS done, {_LEFT} AS rest FROM states),
d AS (SELECT *, CASE WHEN upper({_BACKEND}) <> 'NORMAL' THEN upper({_BACKEND}) WHEN n = 0 OR {_DIAGNOSIS} = 'INSUFFICIENT_EVIDENCE' THEN 'INSUFFICIENT_EVIDENCE' WHEN NOT ({_IN_SITU}) OR n < 5 THEN 'NO_ANOMALY_CONFIRMED' ELSE 'NORMAL' END AS status FROM n)
SELECT event_id, status, replace(status, '_', ' ') AS label, CASE WHEN n = 5 THEN 'All 5 layers assessed this observation.' ELSE 'Assessed by ' || n || ' of 5 layers' || CASE WHEN n > 0 THEN ' (' || done || ')' ELSE '' END || '. Not assessed: ' || rest || '.' END AS detail FROM d""",
)
def q_evidence_display(spark, sf):
    states = {V.LAYER_NAMES[k]: V.layer_state(c(k), c("avail")) for k in _CARDS}
    shown = V.display_status(states, F.expr(_BACKEND), F.expr(_DIAGNOSIS), F.expr(_IN_SITU))
    return _cards(spark, sf).select("event_id", shown.alias("shown")).select("event_id", "shown.*")


_STATUS = "CASE WHEN temperature > 37 OR pressure > 1035 THEN 'anomaly' WHEN event_id % 11 = 0 THEN 'warning' ELSE 'nominal' END"
_READ = f"CASE WHEN {_STATUS} = 'nominal' THEN CASE WHEN event_id % 12 = 5 THEN 'uncertain' ELSE 'nominal' END WHEN event_id % 3 = 0 THEN 'likely_sensor_fault' WHEN event_id % 3 = 1 THEN 'likely_weather_event' ELSE 'communication_issue' END"
_RAN = "coalesce({0} IN ('PASS','WARNING','ANOMALY','VETO'), false)"


@query(
    "EXT10_summary_rule",
    f"""WITH {OBS}, {_LAYERS_SQL}, p AS (SELECT *, {_STATUS} AS status, {_READ} AS interp,
{' + '.join(f"(NOT {_RAN.format(k)})::INT" for k in _CARDS)} AS n, {' + '.join(f"(coalesce({k} = 'INSUFFICIENT_DATA', false))::INT" for k in _CARDS)} AS warming,
concat_ws(', ', {', '.join(f"CASE WHEN NOT {_RAN.format(k)} THEN '{n}' END" for k, n in V.LAYER_NAMES.items())}) AS names,
concat_ws('; ', {', '.join(f"CASE WHEN {k} IN ('WARNING','ANOMALY','VETO') THEN '{k}: ' || lower({k}) END" for k in _CARDS)}) AS told FROM cards),
h AS (SELECT *, upper(status) || ' — ' || (event_id % 101) || '% confidence. ' AS head FROM p)
SELECT event_id, CASE WHEN status = 'nominal' AND interp = 'nominal' THEN CASE WHEN n = 0 THEN head || 'All five layers within nominal envelopes.' ELSE head || (5 - n) || ' of 5 layers assessed, all within nominal envelopes; ' ||
CASE WHEN n = warming THEN 'intelligence history warming up (' || names || ' not yet evaluated).' ELSE 'not evaluated: ' || names || '.' END END
ELSE trim(head || CASE WHEN told <> '' THEN told ELSE 'No individual layer crossed its threshold' END || '. ' || CASE interp {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in V.ENDINGS.items())} ELSE '' END) END AS summary FROM h""",
)
def q_summary_rule(spark, sf):
    cards = {k: (F.coalesce(c(k).isin("WARNING", "ANOMALY", "VETO"), F.lit(False)), c(k), F.lower(k)) for k in _CARDS}
    text = V.summary_sentence(F.expr(_STATUS), (c("event_id") % 101) / 100, F.expr(_READ), cards)
    return _cards(spark, sf).select("event_id", text.alias("summary"))


_RECORD = {
    "kind": "event_type", "case_id": "user_id", "is_anomaly": "coalesce(value > 20, false)", "rules_score": "value / 100",
    "model_score": "CASE WHEN event_type <> 'error' AND event_id % 3 > 0 THEN CAST(event_id * 37 % 100 AS DOUBLE) / 100 END",
    "model_peak": "CASE WHEN event_id % 3 > 0 THEN CAST(event_id * 53 % 100 AS DOUBLE) / 100 END",
}
_RECORD["integrated_score"] = f"greatest(value / 100, coalesce({_RECORD['model_score']}, 0e0))"
_RECORDS_SQL = f"rec AS (SELECT {', '.join(f'{x} AS {k}' for k, x in _RECORD.items())} FROM events)"
_FOUR = ("rules", "model", "peak", "integrated", "rules_normal", "model_normal")


def _records(spark, sf):
    return table(spark, sf, "events").selectExpr(*[f"{x} AS {k}" for k, x in _RECORD.items()])


@query(
    "MDL23_contributions",
    f"""WITH {_RECORDS_SQL}, k AS (SELECT kind, case_id, count(*) FILTER (is_anomaly) AS bad, max(rules_score) FILTER (is_anomaly) AS rules, max(model_score) FILTER (is_anomaly) AS model, max(model_peak) FILTER (is_anomaly) AS peak, max(integrated_score) FILTER (is_anomaly) AS integrated FROM rec GROUP BY 1, 2),
a AS (SELECT kind, count(*) AS cases, sum(bad)::BIGINT AS anomalous_rows, median(rules) AS rules, median(model) AS model, median(peak) AS peak, median(integrated) AS integrated FROM k GROUP BY 1),
n AS (SELECT kind, median(rules_score) AS rules_normal, median(model_score) AS model_normal FROM rec WHERE NOT is_anomaly GROUP BY 1)
SELECT kind, cases, anomalous_rows, CASE WHEN rules IS NULL THEN NULL WHEN coalesce(model, 0) >= 0.7 THEN CASE WHEN rules >= 0.7 THEN 'B' ELSE 'A' END ELSE 'C' END AS class, {', '.join(f'round({x}, 4) AS {x}' for x in _FOUR)} FROM a LEFT JOIN n USING (kind)""",
)
def q_contributions(spark, sf):
    out = K.contributions(_records(spark, sf), "kind", "case_id")
    return out.select("kind", "cases", "anomalous_rows", "class", *[F.round(x, 4).alias(x) for x in _FOUR])


@query(
    "MDL23_threshold_sweep",
    f"WITH {_RECORDS_SQL}, t AS (SELECT unnest({list(K.SWEEP)})::DOUBLE AS threshold) SELECT threshold, round(100 * avg(coalesce(model_peak > threshold, false)::INT) FILTER (is_anomaly), 6) AS anomalous_pct, round(100 * avg(coalesce(model_peak > threshold, false)::INT) FILTER (NOT is_anomaly), 6) AS normal_pct FROM rec, t GROUP BY 1",
)
def q_sweep(spark, sf):
    out = K.threshold_sweep(_records(spark, sf))
    return out.select("threshold", *[F.round(x, 6).alias(x) for x in ("anomalous_pct", "normal_pct")])


_Z = {"zt": "(temperature - 25e0) / 4", "zp": "(pressure - 1010e0) / 5", "zh": "(humidity - 60e0) / 12"}


@query(
    "MDL25_acceptance",
    f"""WITH {OBS}, z AS (SELECT source, {', '.join(f'{x} AS {k}' for k, x in _Z.items())} FROM obs),
s AS (SELECT source, median(zp) AS m, quantile_cont(abs(zp), 0.95) AS p, avg(coalesce(greatest(abs(zt), abs(zp), abs(zh)) > 6, false)::INT) AS f FROM z GROUP BY 1),
k AS (SELECT *, coalesce(m BETWEEN -2 AND 2, false) AS c1, coalesce(p <= 5, false) AS c2, f <= 0.05 AS c3 FROM s)
SELECT source, round(m, 6) AS median_zp, round(p, 6) AS p95_abs_zp, round(f, 6) AS far_share, c1, c2, c3, c1 AND c2 AND c3 AS accepted FROM k""",
)
def q_acceptance(spark, sf):
    z = observations(spark, sf).select("source", *[F.expr(x).alias(k) for k, x in _Z.items()])
    out = K.acceptance(z, "source", "zp", list(_Z))
    return out.select("source", *[F.round(x, 6).alias(x) for x in ("median_zp", "p95_abs_zp", "far_share")], "c1", "c2", "c3", "accepted")


def _u(key: str, purpose: str) -> str:
    return f"((('0x' || substr(md5(({key})::VARCHAR || ':{purpose}'), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE)"


def _n(key: str, purpose: str) -> str:
    return f"(sqrt(-2 * ln({_u(key, purpose + '-u')})) * cos(2 * pi() * {_u(key, purpose + '-v')}))"


_FLOORS = {"temperature": 0.5, "pressure": 0.5, "humidity": 2.0}
_MAD = ", ".join(f"median({x}) AS m{x}" for x in _FLOORS)
_SPREAD = ", ".join(f"greatest(median(abs({x} - m{x})) * 1.4826, {f}) AS d{x}" for x, f in _FLOORS.items())
_NOISY = {x: f"{x} + 3 * d{x} * {_n('event_id', x)}" for x in _FLOORS}
_NOISY["humidity"] = f"CASE WHEN humidity IS NOT NULL THEN greatest(0, least(100, {_NOISY['humidity']})) END"


@query(
    "EXT24_perturbations",
    f"""WITH {OBS}, b AS (SELECT source, {_MAD} FROM obs GROUP BY 1), s AS (SELECT source, {_SPREAD} FROM obs JOIN b USING (source) GROUP BY 1), j AS (SELECT * FROM obs JOIN b USING (source) JOIN s USING (source))
SELECT source, event_id, 'noise_burst' AS scenario, {', '.join(f'round({v}, 5) AS {k}' for k, v in _NOISY.items())} FROM j
UNION ALL SELECT source, event_id, 'combined_abnormal', round(mtemperature + 3 * dtemperature, 5), round(mpressure - 3 * dpressure, 5), 100.0 FROM j""",
)
def q_perturbations(spark, sf):
    obs = observations(spark, sf).select("event_id", "source", *_FLOORS)
    out = Y.disturbed(obs, M.robust_baseline(obs, ["source"], list(_FLOORS)), ["source"], "event_id", _FLOORS)
    return out.select("source", "event_id", "scenario", *[F.round(x, 5).alias(x) for x in _FLOORS])


@query(
    "EXT26_training_states",
    f"""WITH a AS (SELECT event_id, {_u('event_id', 'part')} AS part, {_u('event_id', 'altitude')} AS u FROM events),
h AS (SELECT event_id, CASE WHEN part < 0.5 THEN 500 * u WHEN part < 0.8 THEN 500 + 1000 * u ELSE 1500 + 2000 * u END AS altitude FROM a)
SELECT event_id, round(altitude, 5) AS altitude, round(greatest(-35, least(48, 27 + 8 * {_n('event_id', 'sea')} - 0.0065 * altitude + {_n('event_id', 'warmth')})), 5) AS temperature, round(10 + 90 * {_u('event_id', 'humidity')}, 5) AS humidity,
round(greatest(300, least(1080, 1013.25 * pow(1 - 0.0065 * altitude / 288.15, 9.80665 * 0.0289644::DOUBLE / (8.31447 * 0.0065::DOUBLE)) * (1 + 0.034 * {_n('event_id', 'synoptic')}) + 0.5 * {_n('event_id', 'sensor')})), 5) AS pressure FROM h""",
)
def q_training_states(spark, sf):
    out = Y.training_states(table(spark, sf, "events").select("event_id"), "event_id")
    return out.select("event_id", *[F.round(x, 5).alias(x) for x in ("altitude", "temperature", "humidity", "pressure")])


_TICKS = 24
_AT = "id || '-' || tick"
_WAVE_SUM = "sum(a * cos(kx * lon + ky * lat + phi)) FILTER (field = '{0}') AS w{0}"


@query(
    "SRC12_synthetic_network",
    f"""WITH {ST}, ticks AS (SELECT range AS tick FROM range({_TICKS})), g AS (SELECT range AS wave, CASE WHEN range < 4 THEN 't' WHEN range < 8 THEN 'td' ELSE 'p' END AS field, CASE WHEN range < 8 THEN 0.8 ELSE 0.6 END / sqrt(2) AS sigma,
2 * pi() * 111 / (600 + 900 * {_u('range', 'length')}) AS k, 2 * pi() * {_u('range', 'theta')} AS theta, 2 * pi() * {_u('range', 'phi')} AS phi FROM range(12)),
e AS (SELECT g.*, tick, sqrt(1 - pow(exp(-CASE WHEN tick = 0 THEN 60 ELSE 600 END / 10800::DOUBLE), 2)) * sigma * {_n("wave || '-' || tick", 'wave')} AS e FROM g, ticks),
m AS (SELECT any_value(x.field) AS field, x.wave, y.tick, any_value(x.k * cos(x.theta)) AS kx, any_value(x.k * sin(x.theta)) AS ky, any_value(x.phi) AS phi, sum(x.e * pow(exp(-600 / 10800::DOUBLE), y.tick - x.tick)) AS a FROM e x JOIN ticks y ON x.tick <= y.tick GROUP BY x.wave, y.tick),
w AS (SELECT id, tick, {', '.join(_WAVE_SUM.format(f) for f in Y.FIELDS)} FROM st, m GROUP BY 1, 2),
gust AS (SELECT id, y.tick, sum(1.2 * {_n("id || '-' || x.tick", 'wind')} * pow(0.85::DOUBLE, y.tick - x.tick)) AS gust FROM st, ticks x JOIN ticks y ON x.tick <= y.tick GROUP BY 1, 2),
s AS (SELECT st.*, w.*  EXCLUDE (id), gust, (tick / 6.0::DOUBLE + lon / 15) % 24 AS hour FROM st JOIN w USING (id) JOIN gust USING (id, tick)),
t AS (SELECT *, temperature + 4 * sin(2 * pi() * (hour - 9) / 24) + 0.6 * (2 * {_u('id', 'offset-t')} - 1) + wt + 0.05 * {_n(_AT, 't')} AS t FROM s),
d AS (SELECT *, least(temperature - 8 + 0.8 * (2 * {_u('id', 'offset-td')} - 1) + wtd + 0.08 * {_n(_AT, 'td')}, t - 0.3) AS td FROM t)
SELECT id, tick::INT AS tick, round(round(t / 0.1) * 0.1, 4) AS temperature, round(round(100 * exp(17.62 * td / (243.12 + td) - 17.62 * t / (243.12 + t)) / 0.1) * 0.1, 4) AS humidity,
round(round((pressure + 1.1 * cos(2 * pi() * (hour - 10) / 12) + 0.3 * (2 * {_u('id', 'offset-p')} - 1) + wp + 0.03 * {_n(_AT, 'p')}) / 0.01) * 0.01, 4) AS pressure, round(round(greatest(0, 8 * (1 + 0.3 * sin(2 * pi() * (hour - 9) / 24)) + gust) / 0.1) * 0.1, 4) AS wind_speed FROM d""",
)
def q_network(spark, sf):
    known = stations(spark, sf).select(
        "id", "lat", "lon", c("temperature").cast("double").alias("t_mean"), (c("temperature") - 8).cast("double").alias("td_mean"),
        c("pressure").cast("double").alias("p_base"), F.lit(8.0).alias("wind_mean"),
    )
    return Y.synthetic_network(known, _TICKS)
