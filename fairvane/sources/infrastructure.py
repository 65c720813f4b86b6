"""The CSV catalogue of a dense urban network: places only, no telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What is taken from the catalogue and how it is named.
DEVICE = "Automated weather system"
REGIONS = {
    "Bengaluru": "Karnataka",
    "Chennai": "Tamil Nadu",
    "Delhi NCR": "Delhi NCR",
    "Hyderabad": "Telangana",
    "Kolkata": "West Bengal",
    "Mumbai": "Maharashtra",
    "Pune": "Maharashtra",
}
LATITUDES, LONGITUDES = (6.0, 38.0), (68.0, 98.0)
COLUMNS = ("device_type", "localityId", "latitude", "longitude", "cityName", "localityName")
REJECTS = ("skipped_kind", "skipped_invalid", "duplicates")


def _rows(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """All rows of the catalogue with why each is left out (null: it is not) and its place in the file."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    held = set(raw.columns)
    text = [F.trim(F.coalesce(F.col(f"`{n}`") if n in held else F.lit(None), F.lit(""))).alias(n) for n in COLUMNS]
    rows = raw.select(*text, place.alias("place")).select(
        "*", F.expr("try_cast(latitude AS DOUBLE)").alias("lat"), F.expr("try_cast(longitude AS DOUBLE)").alias("lon")
    )
    inside = F.col("lat").between(*LATITUDES) & F.col("lon").between(*LONGITUDES)
    sound = (F.col("localityId") != "") & F.coalesce(inside, F.lit(False))
    ids = known.select(F.col("id").cast("string").alias("localityId")).distinct().withColumn("taken", F.lit(True))
    kind, invalid, twice = REJECTS
    return rows.join(ids, "localityId", "left").withColumn(
        "reject",
        F.when(~F.col("device_type").contains(DEVICE), kind).when(~sound, invalid).when(F.col("taken"), twice),
    )


def infrastructure_stations(spark: SparkSession, path: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stations of a CSV catalogue that ``known`` (id) does not hold, and one row of counts.

    Of rows with one id the last in the file stays (files by path).  The catalogue holds no telemetry, so
    every station is registered and located, but offline and without a source.  Counts are of rows:
    ``added`` (repeats of an id included), ``skipped_kind``, ``skipped_invalid`` (no id, no number, or
    outside the region) and ``duplicates`` (ids that are known already), each row under its first reason.
    Absent columns read as empty, further ones are not parsed.
    """
    rows = _rows(spark, path, known)
    counts = rows.agg(F.count_if(F.col("reject").isNull()).alias("added"), *[F.count_if(F.col("reject") == r).alias(r) for r in REJECTS])
    last = (
        rows.where(F.col("reject").isNull())
        .groupBy(F.col("localityId").alias("id"))
        .agg(F.max_by(F.struct("lat", "lon", "cityName", "localityName"), "place").alias("x"))
    )
    region = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i in REGIONS.items() for x in i]), F.col("x.cityName")), F.col("x.cityName"))
    named = F.col("x.localityName") != ""
    town = F.concat_ws(", ", F.when(named, F.col("x.localityName")), F.col("x.cityName"), region, F.lit("India"))
    stations = last.select(
        "id",
        F.when(named, F.concat("x.localityName", F.lit(" AWS"))).otherwise(F.concat(F.lit("WeatherUnion AWS "), "id")).alias("name"),
        town.alias("town"),
        F.col("x.lat").alias("latitude"),
        F.col("x.lon").alias("longitude"),
        F.lit("India").alias("country"),
        region.alias("region"),
        F.lit("OFFLINE").alias("status"),
        F.lit("MISSING").alias("data_source"),
        F.lit("TELEMETRY_UNAVAILABLE").alias("telemetry_status"),
    )
    return stations, counts
