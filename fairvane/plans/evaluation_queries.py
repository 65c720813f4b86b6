"""Queries for evaluation over cases and for the fitness of data sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checkpoints as CP
from ..operators import next_step as NS
from ..operators import temporal as T
from .registry import query
from .stand_ins import OBSERVATIONS_SQL as OBS
from .stand_ins import observations

c = F.col
_CHECKPOINTS, _THRESHOLD = (3, 6, 12), 0.9
_CASE = {
    "case_id": "station_id",
    "kind": "CASE station_id % 3 WHEN 0 THEN 'frozen' WHEN 1 THEN 'drift' ELSE 'missing' END",
    "start": "5 + station_id % 20",
    "duration": "10 + station_id % 15",
}
_CASES = [f"{v} AS {k}" for k, v in _CASE.items()]
_RESIDUAL = "CASE WHEN event_id % 5 > 0 AND (station_id % 3 < 2 OR step NOT BETWEEN 8 AND 25) THEN abs(value - 40) END AS residual"
_SCORE = "CASE WHEN event_id % 5 > 0 THEN value / 100 END AS score"
_FIGURES = {
    "onset": "arg_min(residual, step) FILTER (here)",
    "largest": "max(residual) FILTER (here)",
    "near_end": "arg_max(residual, step) FILTER (here)",
    **{f"after_{n}": f"max(residual) FILTER (step = least(start + {n}, stop))" for n in _CHECKPOINTS},
    "persists": f"CASE WHEN count(*) FILTER (here) > 0 THEN coalesce(arg_max(score > {_THRESHOLD}, step) FILTER (inside AND score IS NOT NULL), false) END",
    "crossed": f"coalesce(bool_or(score > {_THRESHOLD}) FILTER (inside), false)",
    "unavailable_share": "avg((residual IS NULL)::INT) FILTER (inside)",
    "unavailable_run": "count(*) FILTER (step >= start AND step < coalesce(open, 1000000000))",
}


@query(
    "AGG18_checkpoint_summary",
    f"""WITH {OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY observed_at, event_id) AS step FROM obs),
k AS (SELECT DISTINCT {', '.join(_CASES)} FROM obs), j AS (SELECT k.*, start + duration - 1 AS stop, step, {_RESIDUAL}, {_SCORE} FROM k JOIN n ON case_id = station_id),
w AS (SELECT *, step BETWEEN start AND stop AS inside, step BETWEEN start AND stop AND residual IS NOT NULL AS here, min(step) FILTER (step >= start AND residual IS NOT NULL) OVER (PARTITION BY case_id) AS open FROM j),
f AS (SELECT case_id, kind, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in _FIGURES.items())} FROM w GROUP BY case_id, kind),
l AS ({' UNION ALL '.join(f"SELECT kind, '{k}' AS figure, {k} AS value FROM f" for k in _FIGURES)})
SELECT kind, figure, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS largest
FROM l WHERE value IS NOT NULL GROUP BY kind, figure""",
)
def q_checkpoints(spark, sf):
    obs = observations(spark, sf)
    cases = obs.selectExpr(*_CASES).distinct()
    steps = obs.withColumn("step", F.row_number().over(T.ordered()))
    scored = steps.selectExpr("station_id AS case_id", "step", _RESIDUAL, _SCORE)
    out = CP.checkpoint_summary(scored, cases, _THRESHOLD, _CHECKPOINTS)
    return out.select("kind", "figure", "n", *[F.round(x, 6).alias(x) for x in ("mean", "median", "p95", "largest")])


_BOUNDS = {"temperature": (12.0, 38.0), "pressure": (995.0, 1035.0), "humidity": (35.0, 100.0)}
#: Times cut to hours, so that steps of one hour and repeats occur.
_HOURS = "date_trunc('hour', observed_at) AS hour_at"
_SPLIT = "CASE WHEN station_id % 10 = 9 AND event_id % 100 = 0 THEN 'test' WHEN station_id % 10 = 8 THEN NULL ELSE 'train' END AS split"


@query(
    "AGG23_dataset_quality",
    f"""WITH {OBS}, a AS (SELECT *, {_HOURS}, {_SPLIT} FROM obs), g AS (SELECT epoch_us(hour_at) - epoch_us(lag(hour_at) OVER (PARTITION BY station_id ORDER BY hour_at)) AS gap FROM a)
SELECT 'rows' AS measure, count(*) AS n FROM a UNION ALL SELECT 'stations', count(DISTINCT station_id) FROM a
UNION ALL SELECT 'repeated', count(*) - (SELECT count(*) FROM (SELECT DISTINCT station_id, hour_at FROM a)) FROM a
UNION ALL SELECT 'wrong_steps', count(*) FROM g WHERE gap <> 3600000000
UNION ALL SELECT 'split_overlap', count(*) FROM (SELECT station_id FROM a GROUP BY 1 HAVING count(DISTINCT split) > 1)
{' '.join(f"UNION ALL SELECT 'missing_{k}', count(*) FROM a WHERE {k} IS NULL UNION ALL SELECT 'outlying_{k}', count(*) FROM a WHERE {k} < {lo} OR {k} > {hi}" for k, (lo, hi) in _BOUNDS.items())}""",
)
def q_quality(spark, sf):
    rows = observations(spark, sf).selectExpr("*", _HOURS, _SPLIT)
    return CP.dataset_quality(rows, "station_id", "hour_at", "split", _BOUNDS, 3600)


_CHANNELS, _HISTORY = ("temperature", "pressure", "humidity"), 10
#: Of each channel: sums over neighbouring whole readings, the line with a ridge of one through them, its residuals.
_SUMS = ", ".join(f"count(*) + 1e0 AS n_{k}, sum(x_{k}) AS x_{k}, sum({k}) AS y_{k}, sum(x_{k} * x_{k}) + 1e0 AS xx_{k}, sum(x_{k} * {k}) AS xy_{k}" for k in _CHANNELS)
_LINES = ", ".join(
    f"(xx_{k} * y_{k} - x_{k} * xy_{k}) / (n_{k} * xx_{k} - x_{k} * x_{k}) AS a_{k}, (n_{k} * xy_{k} - x_{k} * y_{k}) / (n_{k} * xx_{k} - x_{k} * x_{k}) AS b_{k}" for k in _CHANNELS
)


@query(
    "MDL04_next_step_score",
    f"""WITH {OBS}, w AS (SELECT *, {', '.join(f'lag({k}) OVER v AS x_{k}' for k in _CHANNELS)}, row_number() OVER v - 1 AS past FROM obs
WHERE {' AND '.join(f'{k} IS NOT NULL' for k in _CHANNELS)} WINDOW v AS (PARTITION BY station_id ORDER BY observed_at, event_id)),
s AS (SELECT {_SUMS} FROM w WHERE past > 0), l AS (SELECT {_LINES} FROM s),
r AS (SELECT event_id, past, {', '.join(f'CASE WHEN past >= {_HISTORY} THEN {k} - (a_{k} + b_{k} * x_{k}) END AS r_{k}' for k in _CHANNELS)} FROM w, l),
p AS (SELECT {', '.join(f'quantile_cont(abs(r_{k}), 0.99) FILTER (event_id % 5 > 0) AS p_{k}' for k in _CHANNELS)} FROM r),
o AS (SELECT event_id, {', '.join(f'r_{k}' for k in _CHANNELS)}, {', '.join(f'CASE WHEN past >= {_HISTORY} THEN least(abs(r_{k}) / p_{k} / 1.44e0, 1e0) END AS s_{k}' for k in _CHANNELS)}, CASE WHEN past < {_HISTORY} THEN 'insufficient_valid_history' END AS skip_reason FROM r, p)
SELECT obs.event_id, {', '.join(f'round(r_{k}, 5) AS {k}_residual' for k in _CHANNELS)}, round(CASE WHEN s_{_CHANNELS[0]} IS NOT NULL THEN greatest({', '.join(f's_{k}' for k in _CHANNELS)}) END, 6) AS next_step_score,
CASE WHEN o.event_id IS NULL THEN 'current_observation_incomplete' ELSE skip_reason END AS skip_reason FROM obs LEFT JOIN o ON obs.event_id = o.event_id""",
)
def q_next_step_score(spark, sf):
    out = NS.next_step_scores(
        observations(spark, sf), "station_id", ["observed_at", "event_id"], _CHANNELS, _HISTORY, order=1, calibrating=c("event_id") % 5 > 0
    )
    return out.select(
        "event_id", *[F.round(f"{k}_residual", 5).alias(f"{k}_residual") for k in _CHANNELS], F.round("next_step_score", 6).alias("next_step_score"), "skip_reason"
    )
