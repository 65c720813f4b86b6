"""Parsers of inbound records: fixed-format weather records and station payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.physics import humidity_from_dew_point

#: Quality codes of suspect or wrong fields.
BAD_QUALITY = ("2", "3", "6", "7")


def _tenths(field: Column, at: int, quality: int, missing: str) -> Column:
    raw, code = F.get(F.split(field, ","), F.lit(at)), F.get(F.split(field, ","), F.lit(quality))
    number = F.regexp_replace(raw, r"^\+", "").try_cast("double") / 10
    return F.when(F.regexp_replace(raw, r"^\+", "") == missing, None).when(code.isin(*BAD_QUALITY), None).otherwise(number)


def parse_isd(records: DataFrame) -> DataFrame:
    """Temperature, dew point, sea-level pressure, wind (km/h) and humidity of ISD records.

    Columns TMP, DEW, SLP and WND are texts such as ``+0285,1``; 9999 and 99999 mean none.
    """
    temperature, dew = _tenths(F.col("TMP"), 0, 1, "9999"), _tenths(F.col("DEW"), 0, 1, "9999")
    return records.select(
        "*",
        temperature.alias("temperature"),
        dew.alias("dew_point"),
        _tenths(F.col("SLP"), 0, 1, "99999").alias("pressure"),
        (_tenths(F.col("WND"), 3, 4, "9999") * 3.6).alias("wind_speed"),
        F.when(temperature.isNotNull() & dew.isNotNull(), humidity_from_dew_point(temperature, dew)).alias("humidity"),
    )


def adapt_payload(payload: Column) -> Column:
    """Station id and canonical values of a JSON payload in one of three shapes.

    The keys present decide: native; tempf/baromin/windspeedmph with ID or siteid; or
    outTemp with unit_system.  Any other shape gives an error.
    """
    m = F.from_json(payload, T.MapType(T.StringType(), T.StringType()))

    def num(key: str) -> Column:
        return F.try_element_at(m, F.lit(key)).try_cast("double")

    def text(key: str) -> Column:
        return F.try_element_at(m, F.lit(key))

    has = lambda k: F.coalesce(F.map_contains_key(m, k), F.lit(False))
    imperial = has("tempf")
    weewx = has("outTemp")
    us = F.coalesce(text("unit_system") == "US", F.lit(False))
    native = has("id") & has("temperature")
    fahrenheit = lambda x: (x - 32) * 5 / 9
    inches = 33.8638866667
    return F.struct(
        F.when(imperial, "wu").when(weewx, "weewx").when(native, "native").otherwise("error").alias("shape"),
        F.when(imperial, F.coalesce(text("ID"), text("siteid"))).when(weewx, text("station_id")).when(native, text("id")).alias("station_id"),
        F.when(imperial, fahrenheit(num("tempf")))
        .when(weewx, F.when(us, fahrenheit(num("outTemp"))).otherwise(num("outTemp")))
        .when(native, num("temperature"))
        .alias("temperature"),
        F.when(imperial, F.coalesce(num("baromin"), num("barometer")) * inches)
        .when(weewx, F.when(us, num("barometer") * inches).otherwise(num("barometer")))
        .when(native, num("pressure"))
        .alias("pressure"),
        F.when(imperial, num("windspeedmph") * 1.609344)
        .when(weewx, F.when(us, num("windSpeed") * 1.609344).otherwise(num("windSpeed")))
        .when(native, num("windSpeed"))
        .alias("wind_speed"),
    )


def observed_time(text: Column, fallback: Column) -> Column:
    """ISO text or epoch seconds as a time, else the fallback."""
    epoch = F.timestamp_seconds(text.try_cast("double"))
    return F.coalesce(epoch, F.try_to_timestamp(text), fallback)


def station_scan(df: DataFrame, kind: Column, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogue rows of a kind inside the region, last row of each id, and reject counts."""
    region = F.col("lat").between(6, 38) & F.col("lon").between(68, 98)
    marked = df.withColumn("reject", F.when(~kind, "kind").when(~region, "region"))
    counts = marked.groupBy(F.coalesce("reject", F.lit("kept")).alias("reject")).agg(F.count("*").alias("n"))
    kept = marked.where("reject is null").drop("reject")
    last = kept.groupBy("id").agg(F.max_by(F.struct("lat", "lon"), "row").alias("x")).select("id", "x.*")
    return last.join(known, "id", "left_anti"), counts


def poll_round(stations: DataFrame, key: str, per_cycle: int, cycle: int) -> DataFrame:
    """The stations whose turn it is: the cursor goes round in key order.

    The position is by key, so a change of partitioning changes nothing; the catalogue
    is small beside the observations.
    """
    w = Window.orderBy(key)
    total = F.count("*").over(Window.partitionBy(F.lit(1)))
    at = F.row_number().over(w) - 1
    start = cycle * per_cycle
    placed = stations.withColumn("__at", at).withColumn("__n", total)
    return placed.where(F.pmod(F.col("__at") - start, F.col("__n")) < per_cycle).drop("__at", "__n")


def gridded_field(spark: SparkSession, rows: int = 36, columns: int = 72) -> DataFrame:
    """A smooth world temperature field and belts of wind on a latitude-longitude grid."""
    grid = spark.range(rows * columns).select(
        (F.floor(F.col("id") / columns) * (180 / rows) - 90 + 90 / rows).alias("lat"),
        (F.col("id") % columns * (360 / columns) - 180 + 180 / columns).alias("lon"),
    )
    temperature = 28 * F.cos(F.radians("lat")) - 6 + 3 * F.sin(F.radians(F.col("lon") * 2))
    belt = F.abs("lat")
    u = F.when(belt < 30, -6.0).when(belt < 60, 9.0).otherwise(-4.0)
    return grid.select("lat", "lon", temperature.alias("temperature"), u.alias("u"), (F.sin(F.radians(F.col("lat") * 3)) * 2).alias("v"))


#: The scenario sequences' target temperatures by step (base 32 degrees).
SCENARIOS = {
    "normal": (32.0, 32.1, 31.9, 32.0, 32.1, 32.0),
    "spike": (32.0, 32.1, 31.9, 43.5),
    "frozen": (32.1,) * 14,
    "drop": (32.0, 32.1, 31.9, 20.0),
}


def scenario_steps(spark: SparkSession) -> DataFrame:
    rows = [(s, i, 10.0 * i, t) for s, values in SCENARIOS.items() for i, t in enumerate(values)]
    return spark.createDataFrame(rows, "scenario_id string, step int, t_offset_min double, temperature double")


def synthetic_normal(spark: SparkSession, stations: int, steps: int = 1008) -> DataFrame:
    """Seeded diurnal sequences with a slow AR(1) part, ten minutes apart, per station."""
    import zlib

    import numpy as np
    import pandas as pd

    def sequence(batch: pd.DataFrame) -> pd.DataFrame:
        station = int(batch["id"].iloc[0])
        rng = np.random.default_rng(zlib.crc32(f"station-{station}".encode()))
        i = np.arange(steps)
        noise = rng.normal(0, 0.1, steps)
        slow = np.zeros(steps)
        for k in range(1, steps):
            slow[k] = 0.98 * slow[k - 1] + noise[k]
        temperature = np.clip(25 + 5 * np.sin(2 * np.pi * (i / 144 - 0.3)) + slow, -45, 50)
        humidity = np.clip(70 - 2.5 * (temperature - 25) + rng.normal(0, 0.5, steps), 0, 100)
        pressure = 1012 + 1.5 * np.sin(4 * np.pi * i / 144) + rng.normal(0, 0.05, steps)
        return pd.DataFrame({"station_id": station, "step": i, "temperature": temperature, "humidity": humidity, "pressure": pressure})

    ids = spark.range(stations)
    return ids.groupBy("id").applyInPandas(sequence, "station_id long, step long, temperature double, humidity double, pressure double")
