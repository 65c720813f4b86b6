"""Made-up readings and disturbed ones, the same in every run: noise comes from a hash of the row's key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAD_TO_SIGMA
from ..functions import physics as P

#: Fixed values of the training states: share, lowest and highest altitude of each part.
ALTITUDES = ((0.5, 0.0, 500.0), (0.3, 500.0, 1500.0), (0.2, 1500.0, 3500.0))
#: Fixed values of the network: amplitudes, time constant, spread of each field, offsets, steps of the sensors.
DIURNAL_C, TIDE_HPA, TAU_S = 4.0, 1.1, 3 * 3600.0
FIELDS = {"t": 0.8, "td": 0.8, "p": 0.6}
WAVES = 4
RESOLUTION = {"temperature": 0.1, "humidity": 0.1, "pressure": 0.01, "wind_speed": 0.1}


def uniform(key: Column, purpose: str) -> Column:
    """A number in (0, 1) that follows from the key; another purpose gives another number."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{purpose}"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(key: Column, purpose: str) -> Column:
    """A standard normal number that follows from the key."""
    u, v = uniform(key, f"{purpose}-u"), uniform(key, f"{purpose}-v")
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def training_states(rows: DataFrame, key: str) -> DataFrame:
    """Plausible joint states (altitude, temperature, humidity, pressure), one for each row of ``key``."""
    k = F.col(key)
    part, at = uniform(k, "part"), uniform(k, "altitude")
    altitude, upto = None, 0.0
    for share, low, high in ALTITUDES:
        upto += share
        value = low + (high - low) * at
        altitude = F.when(part < upto, value) if altitude is None else altitude.when(part < upto, value)
    altitude = altitude.otherwise(ALTITUDES[-1][1] + (ALTITUDES[-1][2] - ALTITUDES[-1][1]) * at)
    out = rows.select(key, altitude.alias("altitude"))
    warm = 27.0 + 8.0 * normal(k, "sea") - P.LAPSE * F.col("altitude") + normal(k, "warmth")
    pressure = P.hypsometric_pressure(F.col("altitude")) * (1 + 0.034 * normal(k, "synoptic")) + 0.5 * normal(k, "sensor")
    return out.select(
        key, "altitude", P.clip(warm, -35.0, 48.0).alias("temperature"),
        (10.0 + 90.0 * uniform(k, "humidity")).alias("humidity"), P.clip(pressure, 300.0, 1080.0).alias("pressure"),
    )


def disturbed(df: DataFrame, baseline: DataFrame, keys: list[str], row: str, floors: dict[str, float], sigmas: float = 3.0) -> DataFrame:
    """Each row twice: with a burst of noise on all channels, and in a jointly abnormal state.

    ``baseline`` has the median and MAD of each channel by ``keys``; the spread is held to
    ``floors``.  Humidity is held to 0-100; a missing channel stays missing in the burst.
    """

    def scale(c: str) -> Column:
        return F.greatest(F.col(f"{c}_mad") * MAD_TO_SIGMA, F.lit(floors[c]))

    burst = {c: F.col(c) + sigmas * scale(c) * normal(F.col(row), c) for c in floors}
    burst["humidity"] = P.clip(burst["humidity"], 0.0, 100.0)
    joint = {
        "temperature": F.col("temperature_median") + sigmas * scale("temperature"),
        "pressure": F.col("pressure_median") - sigmas * scale("pressure"),
        "humidity": F.lit(100.0),
    }
    both = F.array(
        *[
            F.struct(F.lit(name).alias("scenario"), *[values[c].alias(c) for c in floors])
            for name, values in (("noise_burst", burst), ("combined_abnormal", joint))
        ]
    )
    return df.join(baseline, keys).select(*keys, row, F.inline(both))


def autoregressive(df: DataFrame, keys: list[str], order: str, carry: str, noise: str, name: str) -> DataFrame:
    """``name``: carry * (its value in the row before) + noise, along ``order`` within each key.

    Each key's rows pass through sorted Arrow batches; only the last value is held.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, value = None, 0.0
        for batch in batches:
            out = []
            for now, r, e in zip(zip(*[batch[k] for k in keys]), batch[carry], batch[noise]):
                value = e if now != last else r * value + e
                last = now
                out.append(value)
            yield batch.assign(**{name: out})

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, order)
    return dealt.mapInPandas(run, f"{kinds}, `{name}` double")


def carried(df: DataFrame, noises: str, carry: float) -> DataFrame:
    """The array column ``noises`` made a recursion along itself: carry * (the value before) + noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(noises)
            values = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).copy() if len(batch) else None
            if values is not None and values.size:
                for i in range(1, values.shape[1]):
                    values[:, i] += carry * values[:, i - 1]
                ends = np.arange(len(batch) + 1, dtype=np.int32) * values.shape[1]
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))
                batch = pa.RecordBatch.from_arrays([*batch.columns[:at], made, *batch.columns[at + 1 :]], names=batch.schema.names)
            yield batch

    return df.mapInArrow(run, df.schema)


def synthetic_network(stations: DataFrame, ticks: int, seconds: float = 600.0) -> DataFrame:
    """Readings of every station at each tick: daily wave, tide, regional weather, offsets, sensor steps.

    ``stations``: id, lat, lon, t_mean, td_mean, p_base, wind_mean.  Regional weather is a
    sum of plane waves with amplitudes of first-order memory, so near stations see nearly
    the same.  The amplitudes are one row for each tick, sent to all tasks.  What a station has
    of a wave, its offsets and its gusts are worked out once, before it is spread over the ticks.
    """
    spark = stations.sparkSession
    wave = spark.range(len(FIELDS) * WAVES).withColumnRenamed("id", "wave")
    sigma = F.element_at(F.array(*[F.lit(x / 2**0.5) for x in FIELDS.values()]), (F.col("wave") / WAVES).cast("int") + 1)
    every_tick = F.sequence(F.lit(0), F.lit(ticks - 1))
    gap = F.when(F.col("tick") == 0, 60.0).otherwise(F.lit(seconds))
    keep = F.exp(-gap / TAU_S)
    drawn = wave.select("wave", sigma.alias("sigma"), F.explode(every_tick).alias("tick"))
    noise = F.sqrt(1 - keep * keep) * F.col("sigma") * normal(F.concat_ws("-", "wave", "tick"), "wave")
    waves = autoregressive(drawn.withColumns({"keep": keep, "noise": noise}), ["wave"], "tick", "keep", "noise", "a")
    numbers = range(len(FIELDS) * WAVES)
    regional = waves.groupBy("tick").agg(*[F.max(F.when(F.col("wave") == n, F.col("a"))).alias(f"a{n}") for n in numbers])

    def crest(n: int) -> Column:
        key = F.lit(n)
        angle, number = 2 * F.pi() * uniform(key, "theta"), 2 * F.pi() * 111.0 / (600.0 + 900.0 * uniform(key, "length"))
        return F.cos(number * F.cos(angle) * F.col("lon") + number * F.sin(angle) * F.col("lat") + 2 * F.pi() * uniform(key, "phi"))

    def offset(name: str, size: float) -> Column:
        return size * (2 * uniform(F.col("id"), f"offset-{name}") - 1)

    known = stations.repartition(4 * spark.sparkContext.defaultParallelism, "id").select(
        "*", *[crest(n).alias(f"c{n}") for n in numbers], *[offset(n, x).alias(f"offset_{n}") for n, x in {"t": 0.6, "td": 0.8, "p": 0.3}.items()],
        F.transform(every_tick, lambda tick: 1.2 * normal(F.concat_ws("-", "id", tick), "wind")).alias("gusts"),
    )
    at = carried(known, "gusts", 0.85).select("*", F.posexplode("gusts").alias("tick", "gust")).drop("gusts")
    hour = F.pmod(F.col("tick") * seconds / 3600.0 + F.col("lon") / 15.0, F.lit(24.0))
    at = at.withColumn("hour", hour).join(F.broadcast(regional), "tick")

    def weather(name: str) -> Column:
        first = list(FIELDS).index(name) * WAVES
        return sum((F.col(f"a{n}") * F.col(f"c{n}") for n in range(first, first + WAVES)), F.lit(0.0))

    def jitter(name: str, size: float) -> Column:
        return size * normal(F.concat_ws("-", "id", "tick"), name)

    day = F.sin(2 * F.pi() * (F.col("hour") - 9) / 24)
    at = at.withColumn("t", F.col("t_mean") + DIURNAL_C * day + F.col("offset_t") + weather("t") + jitter("t", 0.05))
    at = at.withColumn("td", F.least(F.col("td_mean") + F.col("offset_td") + weather("td") + jitter("td", 0.08), F.col("t") - 0.3))
    vapour = lambda x: F.lit(17.62) * x / (243.12 + x)
    values = {
        "temperature": F.col("t"),
        "humidity": 100 * F.exp(vapour(F.col("td")) - vapour(F.col("t"))),
        "pressure": F.col("p_base") + TIDE_HPA * F.cos(2 * F.pi() * (F.col("hour") - 10) / 12) + F.col("offset_p") + weather("p") + jitter("p", 0.03),
        "wind_speed": F.greatest(F.lit(0.0), F.col("wind_mean") * (1 + 0.3 * day) + F.col("gust")),
    }
    return at.select("id", "tick", *[F.round(F.round(x / RESOLUTION[n]) * RESOLUTION[n], 4).alias(n) for n, x in values.items()])
