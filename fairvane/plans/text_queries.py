"""Queries for explanations in words and for the infrastructure catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import shared_path
from ..operators import explanations as X
from ..sources import infrastructure as I
from .registry import query
from .stand_ins import OBSERVATIONS_SQL as OBS
from .stand_ins import STATIONS_SQL as ST
from .stand_ins import observations, stations, table

c = F.col

# ---- explanations

_FAULTS = [*X.SENTENCES, "UNHEARD_OF"]
_TIERS = ["HIGH", "MEDIUM", "LOW", "INSUFFICIENT_DATA"]
_REASONS = ["step rate exceeded", "neighbours disagree", "flat line", "next step missed"]
#: One formula for each input of a diagnosis, read alike by both engines.
_DIAGNOSIS = {
    "fault_at": f"event_id % {len(_FAULTS) + 1}",
    "tier_at": "CAST(floor(event_id / 13) AS BIGINT) % 5",
    "reasons_n": "event_id % 5",
    "signal": "CASE WHEN event_id % 3 = 0 THEN 'pressure' WHEN event_id % 3 = 1 THEN '' END",
    "health": "CAST(event_id % 1001 AS DOUBLE) / 10",
    "days": "CASE WHEN event_id % 6 > 0 THEN CAST(event_id % 90 AS DOUBLE) / 2 END",
    "alternatives_n": "event_id % 3",
}
_MADE = ", ".join(f"{v} AS {k}" for k, v in _DIAGNOSIS.items())
_LISTS = ", ".join(f"'{x}'" for x in _REASONS)
_SHOWN = {n: f"format('{{:.1f}}', {n}) || '{unit}'" for n, (_, _, unit) in X.CHANNELS.items()}


def _joined(parts: list[str], otherwise: str) -> str:
    return f"coalesce(nullif(array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ', '), ''), '{otherwise}')"


_NORMAL = _joined([f"'{label}' || {_SHOWN[n]}" for n, (label, _, _) in X.CHANNELS.items()], X.NO_CHANNELS)
_OBSERVED = _joined(
    [f"CASE WHEN event_id % {10 + i} > 0 THEN '{short}' || {_SHOWN[n]} END" for i, (n, (_, short, _)) in enumerate(X.CHANNELS.items())], X.NO_VALUES
)
_PLACES = {
    "station": "station_id::VARCHAR",
    "health": "format('{:.0f}', health)",
    "normal": "normal",
    "observed": "observed",
    "evidence": "evidence",
    "signal": f"CASE WHEN evidence = '' THEN '{X.NO_SIGNAL}' ELSE evidence END",
    "certainty": "certainty",
    "advice": "advice",
    "alternative": "CASE WHEN alternatives_n > 0 THEN ' Alternative: NOISE_BURST.' ELSE '' END",
    "extrapolation": f"CASE WHEN days < {X.EXTRAPOLATION_DAYS} THEN replace('{X.EXTRAPOLATION}', '{{days}}', format('{{:.0f}}', days)) ELSE '' END",
}
_TEXT = "template"
for _name, _value in _PLACES.items():
    _TEXT = f"replace({_TEXT}, '{{{_name}}}', {_value})"


def _texts(by: dict[str, str], otherwise: str) -> str:
    return "CASE tier " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in by.items()) + f" ELSE '{otherwise}' END"


@query(
    "PRJ17_explanation_text",
    f"""WITH {OBS}, a AS (SELECT *, {_MADE} FROM obs),
b AS (SELECT *, ({_FAULTS})[fault_at + 1] AS fault, ({_TIERS})[tier_at + 1] AS tier, ([{_LISTS}])[1:least(reasons_n, {X.SHOWN_REASONS})] AS told FROM a),
t AS (SELECT unnest({list(X.SENTENCES)}) AS fault, unnest([{', '.join("'" + s + "'" for s in X.SENTENCES.values())}]) AS template),
d AS (SELECT b.*, coalesce(template, '{X.OTHER_SENTENCE}') AS template, CASE WHEN reasons_n > 0 THEN array_to_string(told, '; ') ELSE coalesce(signal, '') END AS evidence,
{_texts(X.CERTAINTY, X.NO_CERTAINTY)} AS certainty, {_texts(X.ADVICE, X.NO_ADVICE)} AS advice, {_NORMAL} AS normal, {_OBSERVED} AS observed FROM b LEFT JOIN t USING (fault))
SELECT event_id, fault, {_TEXT} AS explanation FROM d""",
)
def q_explanation(spark, sf):
    def nth(texts: list[str], at: str):
        return F.get(F.array(*[F.lit(x) for x in texts]), c(at).cast("int"))

    made = observations(spark, sf).selectExpr("*", *[f"{v} AS {k}" for k, v in _DIAGNOSIS.items()])
    told = made.select(
        "*",
        nth(_FAULTS, "fault_at").alias("fault"),
        F.slice(F.array(*[F.lit(x) for x in _REASONS]), F.lit(1), c("reasons_n").cast("int")).alias("reasons"),
        F.slice(F.array(F.lit("NOISE_BURST"), F.lit("FROZEN_SENSOR")), F.lit(1), c("alternatives_n").cast("int")).alias("alternatives"),
    )
    usable = {n: c("event_id") % (10 + i) > 0 for i, n in enumerate(X.CHANNELS)}
    text = X.explanation(
        c("fault"), nth(_TIERS, "tier_at"), c("station_id"), {n: c(n) for n in X.CHANNELS}, usable,
        c("reasons"), c("signal"), c("health"), c("days"), c("alternatives"),
    )
    return told.select("event_id", "fault", text.alias("explanation"))


# ---- the infrastructure catalogue

_CITIES = [*I.REGIONS, "Jaipur"]
_CSV = {
    "device_type": f"CASE WHEN segment = 'MACHINERY' THEN 'Rain gauge system' ELSE '{I.DEVICE} - v' || CAST(id % 3 AS VARCHAR(9)) END",
    "localityId": "CASE WHEN id % 41 = 0 THEN ' ' ELSE 'L' || CAST(id % 700 AS VARCHAR(9)) END",
    "latitude": "CASE WHEN id % 37 = 0 THEN 'north' WHEN id % 43 = 0 THEN '' WHEN id % 47 = 0 THEN 'NaN' WHEN id % 53 = 0 THEN '5.99' ELSE CAST(CAST(600 + id % 3201 AS DOUBLE) / 100 AS VARCHAR(9)) END",
    "longitude": "CASE WHEN id % 59 = 0 THEN '98.01' ELSE CAST(CAST(6800 + id % 3001 AS DOUBLE) / 100 AS VARCHAR(9)) END",
    "localityName": "CASE WHEN id % 7 = 0 THEN '' WHEN id % 11 = 0 THEN 'Ward \"' || CAST(id % 90 AS VARCHAR(9)) || '\", East' ELSE 'Ward ' || CAST(id % 90 AS VARCHAR(9)) END",
}
_ROWS = (
    f"raw AS (SELECT id, {', '.join(f'{v} AS {k}' for k, v in _CSV.items())}, ({_CITIES})[id % {len(_CITIES)} + 1] AS city FROM st), "
    "num AS (SELECT *, TRY_CAST(latitude AS DOUBLE) AS lat, TRY_CAST(longitude AS DOUBLE) AS lon FROM raw), "
    f"marked AS (SELECT *, CASE WHEN NOT contains(device_type, '{I.DEVICE}') THEN 'skipped_kind' "
    "WHEN trim(localityId) = '' OR lat IS NULL OR lon IS NULL OR isnan(lat) OR NOT (lat >= 6 AND lat <= 38 AND lon >= 68 AND lon <= 98) THEN 'skipped_invalid' "
    "WHEN localityId IN (SELECT 'L' || n_nationkey FROM nation) THEN 'duplicates' ELSE 'added' END AS why FROM num)"
)


def _catalogue(spark, sf):
    city = F.get(F.array(*[F.lit(x) for x in _CITIES]), (c("id") % len(_CITIES)).cast("int"))
    rows = stations(spark, sf).orderBy("id").select(*[F.expr(v).alias(k) for k, v in _CSV.items()], city.alias("cityName"), "name")
    path = shared_path(spark, "infrastructure")
    rows.write.option("header", True).option("escape", '"').csv(path)
    known = table(spark, sf, "nation").select(F.concat(F.lit("L"), "n_nationkey").alias("id"))
    return I.infrastructure_stations(spark, path, known)


@query(
    "SRC02_infrastructure_csv",
    f"""WITH {ST}, {_ROWS}, last AS (SELECT *, row_number() OVER (PARTITION BY localityId ORDER BY id DESC) AS r FROM marked WHERE why = 'added'),
named AS (SELECT *, CASE city {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in I.REGIONS.items())} ELSE city END AS region FROM last WHERE r = 1)
SELECT localityId AS id, CASE WHEN localityName = '' THEN 'WeatherUnion AWS ' || localityId ELSE localityName || ' AWS' END AS name,
CASE WHEN localityName = '' THEN '' ELSE localityName || ', ' END || city || ', ' || region || ', India' AS town, lat AS latitude, lon AS longitude, 'India' AS country, region,
'OFFLINE' AS status, 'MISSING' AS data_source, 'TELEMETRY_UNAVAILABLE' AS telemetry_status FROM named""",
)
def q_infrastructure(spark, sf):
    return _catalogue(spark, sf)[0]


@query(
    "SRC02_infrastructure_counts",
    f"WITH {ST}, {_ROWS} SELECT {', '.join(f'''count(*) FILTER (why = '{w}') AS {w}''' for w in ('added', *I.REJECTS))} FROM marked",
)
def q_infrastructure_counts(spark, sf):
    return _catalogue(spark, sf)[1]
