"""Queries for the keyed machines and logs of the streaming chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.incidents import INCIDENT_EDGES
from ..operators import spatial as S
from ..streaming import event_registry as ER
from ..streaming import stations as M
from .registry import query
from .stand_ins import STATION, table

c = F.col

# ---- the station machine: every sixth event is an operator's action, the others are readings

_CADENCE_S = 10_800
_UNTIL_MS = 1_706_659_200_000
_ACTIONS = "CASE event_id % 5 WHEN 0 THEN 'ACKNOWLEDGED' WHEN 1 THEN 'INVESTIGATING' WHEN 2 THEN 'ESCALATED' WHEN 3 THEN 'RESOLVED' ELSE 'DISMISSED' END"
_STATUS = "CASE WHEN value > 90 THEN 'ANOMALY' WHEN value > 45 THEN 'WARNING' ELSE 'NORMAL' END"
_MS, _STALE, _OUT = "CAST(epoch_us(ts) // 1000 AS BIGINT)", 3 * _CADENCE_S * 1000 + 1, 5 * _CADENCE_S * 1000 + 1
_EDGES = ", ".join(f"'{a}>{b}'" for a, b in INCIDENT_EDGES)

MACHINE_SQL = f"""WITH RECURSIVE e AS (SELECT user_id AS station_id, {_MS} AS at_, event_id, event_id % 6 = 5 AS act, {_ACTIONS} AS action,
  CAST(user_id AS VARCHAR) || '-' || CAST(epoch_us(ts) // 7200000000 AS VARCHAR) AS oid, epoch_us(ts) - CASE WHEN event_id % 11 = 0 THEN 86400000000 ELSE 0 END AS obs,
  CASE WHEN day(ts) > 15 THEN 'SIMULATED' ELSE 'MEASURED' END AS source, {_STATUS} AS status, event_id % 3 > 0 AS diagnosed FROM events),
k AS (SELECT *, NOT act AND coalesce(lag(at_) OVER (PARTITION BY station_id, act, oid ORDER BY at_, event_id) >= at_ - 86400000, false) AS known,
  row_number() OVER (PARTITION BY station_id ORDER BY at_, event_id) AS rn FROM e),
s AS (SELECT station_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS at_, CAST(NULL AS BIGINT) AS rx, CAST(-1 AS BIGINT) AS last_us, CAST(NULL AS VARCHAR) AS src,
  CAST(0 AS BIGINT) AS streak, CAST(0 AS BIGINT) AS abn, 'nominal' AS shown, CAST(0 AS BIGINT) AS no, CAST(NULL AS VARCHAR) AS inc, 'start' AS tag, CAST(NULL AS VARCHAR) AS oid, false AS watch FROM (SELECT DISTINCT station_id FROM e)
  UNION ALL SELECT station_id, rn, at_, rx, last_us, src, streak, abn, shown,
    CASE WHEN opens THEN no + 1 ELSE no END, CASE WHEN opens THEN 'NEW' WHEN tag = 'action' THEN action ELSE inc END, CASE WHEN opens THEN 'opened' ELSE tag END, oid, status = 'WARNING' AND shown = 'nominal'
  FROM (SELECT *, tag = 'judged' AND (shown = 'fault' OR (shown = 'suspect' AND abn >= 2)) AND (inc IS NULL OR inc IN ('RESOLVED', 'DISMISSED')) AS opens
  FROM (SELECT * REPLACE (CASE WHEN tag <> 'judged' THEN abn WHEN shown = 'nominal' THEN 0 ELSE abn + 1 END AS abn)
  FROM (SELECT * REPLACE (CASE WHEN tag <> 'judged' THEN shown WHEN status = 'ANOMALY' THEN 'fault' WHEN streak >= 2 THEN 'suspect' ELSE 'nominal' END AS shown)
  FROM (SELECT x.station_id, x.rn, x.at_, x.oid, x.status, x.action, p.shown, p.no, p.inc, CASE WHEN x.act THEN p.rx ELSE x.at_ END AS rx,
    CASE WHEN x.act THEN CASE WHEN p.inc IS NOT NULL AND p.inc || '>' || x.action IN ({_EDGES}) THEN 'action' ELSE 'rejected' END WHEN x.known THEN 'known' WHEN x.obs <= p.last_us THEN 'late' ELSE 'judged' END AS tag,
    CASE WHEN x.act OR x.known OR x.obs <= p.last_us THEN p.last_us ELSE x.obs END AS last_us, CASE WHEN x.act OR x.known OR x.obs <= p.last_us THEN p.src ELSE x.source END AS src,
    CASE WHEN x.act OR x.known OR x.obs <= p.last_us THEN p.streak WHEN x.status = 'WARNING' AND x.diagnosed THEN CASE WHEN p.src <> x.source THEN 1 ELSE p.streak + 1 END ELSE 0 END AS streak,
    CASE WHEN NOT (x.act OR x.known OR x.obs <= p.last_us) AND p.src <> x.source THEN 0 ELSE p.abn END AS abn
    FROM s p JOIN k x ON x.station_id = p.station_id AND x.rn = p.rn + 1))))),
b AS (SELECT *, lag(shown) OVER w AS shown0, lag(no) OVER w AS no0, lag(inc) OVER w AS inc0, lag(rx) OVER w AS rx0, lag(streak) OVER w AS streak0 FROM s WINDOW w AS (PARTITION BY station_id ORDER BY rn)),
j AS (SELECT * FROM b WHERE tag IN ('judged', 'opened')),
g AS (SELECT station_id, rx, coalesce(lead(at_) OVER (PARTITION BY station_id ORDER BY rn), {_UNTIL_MS}) AS next_at FROM b WHERE tag NOT IN ('start', 'action', 'rejected')),
q AS (SELECT station_id, rx + {_STALE} AS at_, 'STATION_STALE' AS event, 'STALE' AS f FROM g WHERE rx + {_STALE} <= next_at UNION ALL SELECT station_id, rx + {_OUT}, 'OUTAGE_OPENED', 'OUTAGE' FROM g WHERE rx + {_OUT} <= next_at),
o AS (SELECT q.station_id, q.at_ AS at_ms, q.event, CAST(NULL AS VARCHAR) AS observation_id, b.shown, false AS watch, b.streak, q.f AS freshness, b.no AS no, b.inc AS inc FROM q ASOF JOIN b ON b.station_id = q.station_id AND q.at_ > b.at_
UNION ALL SELECT station_id, at_, 'TELEMETRY_RESTORED', oid, shown0, false, streak0, 'LIVE', no0, inc0 FROM b WHERE tag NOT IN ('start', 'action', 'rejected') AND at_ >= rx0 + {_OUT}
UNION ALL SELECT station_id, at_, CASE tag WHEN 'known' THEN 'DUPLICATE' ELSE 'LATE' END, oid, shown, false, streak, 'LIVE', no, inc FROM b WHERE tag IN ('known', 'late')
UNION ALL SELECT station_id, at_, 'STATION_UPDATED', oid, shown, watch, streak, 'LIVE', no0, inc0 FROM j
UNION ALL SELECT station_id, at_, 'ANOMALY_DETECTED', oid, shown, false, streak, 'LIVE', no0, inc0 FROM j WHERE shown <> 'nominal' AND (shown0 = 'nominal' OR (shown0 = 'suspect' AND shown = 'fault'))
UNION ALL SELECT station_id, at_, 'STATION_RECOVERED', oid, shown, watch, streak, 'LIVE', no0, inc0 FROM j WHERE shown = 'nominal' AND shown0 <> 'nominal'
UNION ALL SELECT station_id, at_, 'INCIDENT_CREATED', oid, shown, false, streak, 'LIVE', no, inc FROM b WHERE tag = 'opened'
UNION ALL SELECT station_id, at_, CASE tag WHEN 'action' THEN 'INCIDENT_' || inc ELSE 'ACTION_REJECTED' END, CAST(NULL AS VARCHAR), shown, false, streak,
  CASE WHEN at_ >= rx + {_OUT} THEN 'OUTAGE' WHEN at_ >= rx + {_STALE} THEN 'STALE' ELSE 'LIVE' END, no, inc FROM b WHERE tag IN ('action', 'rejected'))
SELECT station_id, at_ms, event, observation_id, shown, watch, CAST(streak AS INT) AS streak, freshness, CAST(no AS INT) AS incident_no, inc AS incident_status FROM o"""


def machine_rows(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "user_id AS station_id",
        "CAST(ts AS TIMESTAMP) AS received",
        "event_id AS row_id",
        "CASE WHEN event_id % 6 = 5 THEN 'action' ELSE 'reading' END AS kind",
        "concat(user_id, '-', unix_micros(CAST(ts AS TIMESTAMP)) div 7200000000) AS observation_id",
        "unix_micros(CAST(ts AS TIMESTAMP)) - CASE WHEN event_id % 11 = 0 THEN 86400000000 ELSE 0 END AS observed_us",
        "CASE WHEN day(ts) > 15 THEN 'SIMULATED' ELSE 'MEASURED' END AS source",
        f"{_STATUS} AS status",
        "event_id % 3 > 0 AS diagnosed",
        f"{_ACTIONS} AS action",
        f"{_CADENCE_S}e0 AS cadence_s",
    )


@query("ST09_ST10_ST12_station_machine", MACHINE_SQL)
def q_machine(spark, sf):
    """Freshness, alarms and incidents of every station, as one machine over readings, actions and silence."""
    return M.machine_batch(machine_rows(spark, sf), _UNTIL_MS)


# ---- regional events over thirty snapshots, ten minutes apart, in each network


def event_clusters(spark, sf):
    """Clusters of stations whose value is high: one snapshot for each day, on a ten-minute clock.

    Every seventh snapshot is skipped and every fifth comes twenty minutes late, so that events end.
    """
    place = {k: STATION[k].replace("c_custkey", "user_id") for k in ("lat", "lon")}
    hot = table(spark, sf, "events").where("value > 40").selectExpr(
        "event_type AS network",
        "day(ts) AS d",
        "user_id",
        *[f"{x} AS {k}" for k, x in place.items()],
        "value",
        "CASE event_id % 3 WHEN 0 THEN 'temperature' WHEN 1 THEN 'pressure' ELSE 'humidity' END AS channel",
        "(user_id + day(ts) % 3) div 4 AS cluster",
    )
    by = ["network", "d", "cluster"]
    groups = hot.where("d % 7 > 0").groupBy(*by).agg(
        F.array_sort(F.collect_set("user_id")).alias("members"),
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        F.array_sort(F.collect_set("channel")).alias("channels"),
        F.round(F.avg("value") / 10, 6).alias("magnitude"),
    )
    wide = S.extents(hot.select(F.struct(*by).alias("g"), F.col("user_id").alias("id"), "lat", "lon"), "g")
    at = (c("d") * 10 + F.when(c("d") % 5 == 0, 6).otherwise(0)) * F.lit(60_000_000).cast("long")
    joined = groups.withColumn("g", F.struct(*by)).join(wide, "g", "left")
    return joined.select("network", at.cast("long").alias("at_us"), c("cluster").cast("long").alias("cluster"), "members", "lat", "lon", "channels", "magnitude", "extent_km")


@query("ST15_event_registry")
def q_registry(spark, sf):
    """What becomes of regional events over all snapshots of each network."""
    return ER.registry_batch(event_clusters(spark, sf))
