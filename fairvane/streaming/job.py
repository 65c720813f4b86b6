"""The streaming job: micro-batches over the same operators that batches use.

Late rows are split off, not dropped; a batch is scored as one snapshot; appends are
idempotent by observation id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.drift import kernel
from ..operators.normalise import new_rows, observation_id

STATE = "t double, ema double, up double, down double, last_us long, source string"
SCORED = (
    "station_id long, event_id long, observed_us long, late boolean, ema double, up double, down double, score double"
)


def deduplicated(stream: DataFrame, memory: str = "6 hours") -> DataFrame:
    """Rows once by observation id, however old their observation is.

    Ids are remembered by the time at which a row enters the stream, so no row is behind the
    watermark and none is dropped as late; what is older than ``memory`` the sink holds back.
    """
    made = observation_id(F.col("station_id").cast("string"), F.col("source"), F.col("observed_at"))
    part = F.date_format("observed_at", "SSSSSS")  # the id tells whole seconds, and a second may hold several observations
    made = F.concat_ws(".", made, F.when(part != "000000", part))
    timed = stream.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withColumn("observation_id", made)
    entered = timed.withColumn("entered_at", F.current_timestamp()).withWatermark("entered_at", memory)
    return entered.dropDuplicatesWithinWatermark(["observation_id"]).drop("entered_at")


def _scored(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Late split and drift recursion of one station; its state is reset when its source changes."""
    names = ("t", "ema", "up", "down")
    last_us, source, held = -1, None, {}
    if state.exists:
        *values, last_us, source = state.get
        held = {k: v for k, v in zip(names, values) if v is not None}
    out = []
    rows = pd.concat(list(batches)).sort_values(["observed_us", "event_id"])
    for row in rows.itertuples(index=False):
        late = row.observed_us <= last_us
        if late:
            out.append((key[0], row.event_id, row.observed_us, True, None, None, None, None))
            continue
        if source is not None and row.source_class != source:
            held = {}
        source, last_us = row.source_class, row.observed_us
        (_, ema, up, down, score) = kernel(held, iter([(row.observed_us / 1e6, row.residual)]))[0]
        out.append((key[0], row.event_id, row.observed_us, False, ema, up, down, score))
    state.update((*(held.get(n) for n in names), last_us, source))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in SCORED.split(", ")])


def drift_stream(observations: DataFrame) -> DataFrame:
    """Keyed drift state per station over a stream (or a batch) of residuals.

    ``observations`` has station_id, event_id, observed_us, residual and source_class.
    """
    return observations.groupBy("station_id").applyInPandasWithState(
        _scored, SCORED, STATE, "append", GroupStateTimeout.NoTimeout
    )


def append_once(batch: DataFrame, path: str, key: str, day: str | None = None) -> None:
    """foreachBatch sink: rows whose key the table lacks are appended, so a retry adds none.

    With ``day`` (a time column that the key determines) the table is partitioned by date, and only
    the dates of the batch are read again.
    """
    spark = batch.sparkSession
    if day is not None:
        batch = batch.withColumn("date", F.to_date(day))
    writer = lambda rows: rows.write.mode("append").partitionBy(*(["date"] if day else []))
    try:
        existing = spark.read.schema(batch.schema).parquet(path)
    except Exception as e:  # the table doesn't exist before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        writer(batch.dropDuplicates([key])).parquet(path)
        return
    if day is not None:
        existing = existing.where(F.col("date").isin([r[0] for r in batch.select("date").distinct().collect()]))  # dates of one batch
    writer(new_rows(batch, existing, key)).parquet(path)


def snapshot(pool: DataFrame, batch: DataFrame, key: str = "id", time: str = "observed_at") -> DataFrame:
    """The latest row of each station over pool and batch: the pool never goes backwards."""
    rest = [c for c in pool.columns if c != key]
    both = pool.unionByName(batch.select(*pool.columns))
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), time).alias("x")).select(key, "x.*")


def run_available(spark: SparkSession, source: DataFrame, sink_path: str, checkpoint: str, key: str = "event_id", day: str | None = None) -> None:
    """Process what is there in micro-batches and stop; exactly once into ``sink_path``."""
    query = (
        source.writeStream.foreachBatch(lambda batch, _: append_once(batch, sink_path, key, day))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def replayed(observations: DataFrame, markers: dict[str, str]) -> DataFrame:
    """First time at which each marker condition holds, per station, over a bounded slice."""
    return observations.groupBy("station_id").agg(*[F.min(F.when(F.expr(cond), F.col("observed_at"))).alias(name) for name, cond in markers.items()])
