"""Telemetry tables made from the driver's tables by plain arithmetic on their keys.

Every derived column has one formula, in SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OBSERVATION = {
    "event_id": "event_id",
    "station_id": "user_id",
    "observed_at": "ts",
    "source": "event_type",
    "value": "value",
    "temperature": "CASE WHEN event_id % 17 = 0 THEN NULL WHEN user_id % 5 = 0 AND day(ts) BETWEEN 8 AND 22 THEN 21.5e0 "
    "ELSE CAST(100 + event_id * 37 % 300 AS DOUBLE) / 10 END",
    "pressure": "CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(9900 + event_id * 53 % 500 AS DOUBLE) / 10 END",
    "humidity": "CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(300 + event_id * 29 % 750 AS DOUBLE) / 10 END",
    "wind_speed": "CAST(event_id * 31 % 1100 AS DOUBLE) / 10",
    "wind_direction": "CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(event_id * 41 % 360 AS DOUBLE) END",
    "rainfall": "CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 50 AS DOUBLE) / 10 ELSE 0e0 END",
}
STATION = {
    "id": "c_custkey",
    "name": "c_name",
    "lat": "CAST(80 + c_custkey * 37 % 290 AS DOUBLE) / 10 + CAST(c_custkey * 7 % 13 AS DOUBLE) / 100",
    "lon": "CAST(690 + c_custkey * 53 % 280 AS DOUBLE) / 10 + CAST(c_custkey * 11 % 17 AS DOUBLE) / 100",
    "elevation": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey * 13 % 1500 AS DOUBLE) END",
    "source": "CASE WHEN c_custkey % 3 = 0 THEN 'SIMULATED_AWS' ELSE 'AWS_IN_SITU' END",
    "observed_at": "TIMESTAMP '2024-01-01 12:00:00' + CAST(c_custkey * 17 % 60 AS INT) * INTERVAL '1' MINUTE",
    "temperature": "20e0 + c_acctbal / 1000",
    "pressure": "1000e0 + c_acctbal / 500",
    "humidity": "CAST(300 + c_custkey * 29 % 700 AS DOUBLE) / 10",
    "segment": "c_mktsegment",
    "nation": "c_nationkey",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


#: The same tables for SQL: a list of common table expressions.
OBSERVATIONS_SQL = f"obs AS (SELECT {_select(OBSERVATION)} FROM events)"
STATIONS_SQL = f"st AS (SELECT {_select(STATION)} FROM customer)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _made(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(table(spark, sf_dir, "events"), OBSERVATION)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = dict(STATION, observed_at="timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(0, 0, CAST(c_custkey * 17 % 60 AS INT), 0)")
    return _made(table(spark, sf_dir, "customer"), spec)
