"""File sources of stations and observations, and writers of offline artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import humidity_reading, pressure_reading, temperature_reading, wind_reading

CATALOGUE = "id string, name string, town string, latitude double, longitude double, temperature double, humidity double, pressure double"


def station_catalogue(spark: SparkSession, path: str, schema: str = CATALOGUE) -> DataFrame:
    """Stations of a JSON array, with the provenance and freshness a static snapshot can claim.

    A station with any reading (a pressure of zero is none) is in situ with unknown
    freshness; without one both are missing.  The observation time is not known.
    """
    stations = spark.read.schema(schema).option("multiLine", True).json(path)
    has_value = F.col("temperature").isNotNull() | F.col("humidity").isNotNull() | F.coalesce(F.col("pressure") != 0, F.lit(False))
    return stations.select(
        "*",
        F.when(has_value, "AWS_IN_SITU").otherwise("MISSING").alias("data_source"),
        F.lit(None).cast("timestamp").alias("observation_time"),
        F.when(has_value, "UNKNOWN").otherwise("MISSING").alias("freshness"),
    )


_MARKERS = "struct<markers: array<struct<id: string, town: string, lat: string, long: string, conds: string>>>"


def marker_map(files: DataFrame) -> DataFrame:
    """Stations of map scripts (``content``, one file a row): a JSON object after any script prefix.

    The place is split into name, region and country; markers without valid coordinates
    are dropped; conditions are a comma-separated list whose readings carry their units.
    """
    start = F.instr("content", "{")
    parsed = F.from_json(F.when(start > 0, F.expr("substring(content, instr(content, '{'))")), _MARKERS)
    m = files.select(F.inline(parsed.getField("markers")))
    lat, lon = (F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in ("lat", "long"))
    places = F.filter(F.transform(F.split(F.coalesce("town", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    tokens = F.transform(F.split("conds", ","), lambda x: F.trim(x))
    located = m.select(
        "id", places.alias("places"), F.coalesce(lat, F.when(F.col("lat").isNull(), 0.0)).alias("latitude"),
        F.coalesce(lon, F.when(F.col("long").isNull(), 0.0)).alias("longitude"), "conds", tokens.alias("tokens"),
    ).where("abs(latitude) <= 90 AND abs(longitude) <= 180")
    online = F.coalesce((F.col("conds") != "Offline") & (F.col("conds") != ""), F.lit(False))

    def token(i: int, empty: str | None = None) -> Column:
        t = F.get("tokens", F.lit(i))
        return t if empty is None else F.when(F.coalesce(t, F.lit("")) == "", empty).otherwise(t)

    def when_online(value: Column, otherwise: Column | None = None) -> Column:
        return F.when(online, value) if otherwise is None else F.when(online, value).otherwise(otherwise)

    return located.select(
        "id",
        F.coalesce(F.get("places", F.lit(0)), F.concat(F.lit("Station "), "id")).alias("name"),
        F.when(F.size("places") >= 2, F.element_at("places", -2)).otherwise("Unknown").alias("region"),
        F.when(F.size("places") >= 1, F.element_at("places", -1)).otherwise("Unknown").alias("country"),
        "latitude",
        "longitude",
        F.when(online, "ONLINE").otherwise("OFFLINE").alias("status"),
        when_online(token(1, "Reported"), F.lit("Offline")).alias("condition"),
        when_online(temperature_reading(token(2))).alias("temperature"),
        when_online(humidity_reading(token(3))).alias("humidity"),
        when_online(token(5, "CALM")).alias("wind_direction"),
        when_online(F.when(F.size("tokens") > 6, wind_reading(token(6))).otherwise(0.0)).alias("wind_speed"),
        when_online(pressure_reading(token(9))).alias("pressure"),
    )


def pruned_csv(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """Only ``columns`` of a CSV with a header; the scan parses no others, and its splits are the chunks."""
    return spark.read.schema(schema).option("header", True).csv(path).select(*columns)


def write_artifact(df: DataFrame, path: str, form: str = "parquet") -> str:
    """An offline artifact as csv (with a header), json or parquet, replacing an earlier one."""
    if form not in ("csv", "json", "parquet"):
        raise ValueError(f"no artifact form {form!r}")
    df.write.mode("overwrite").format(form).options(**({"header": "true"} if form == "csv" else {})).save(path)
    return path
