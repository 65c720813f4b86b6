"""Observations pushed as request bodies: one item or a list, each item judged by itself.

A body with more items than allowed is rejected whole; a bad item leaves the others of its request
as they are and is given out with its place and the reason.  Callers can't set ``meta``, which
records where an observation comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Items of a request, and what a station's id looks like.
MOST_ITEMS, STATION_ID = 5000, r"^[A-Za-z0-9_.:\-]{1,64}$"
CHANNELS = ("temperature", "humidity", "pressure", "wind_speed", "wind_direction", "rainfall", "dew_point")


def items(requests: DataFrame) -> DataFrame:
    """request, place, item (text) of each item of ``requests`` (request, body); reason of whole bodies that fail."""
    listed = F.from_json("body", "observations array<string>")["observations"]
    is_object = F.get_json_object("body", "$").startswith("{")
    several = F.when(listed.isNotNull(), listed).when(is_object, F.array("body"))
    read = requests.select("request", "body", several.alias("several"))
    reason = F.when(F.col("several").isNull(), "NOT_JSON").when(F.size("several") > MOST_ITEMS, "TOO_MANY_ITEMS")
    read = read.withColumn("reason", reason)
    whole = F.when(F.col("reason").isNotNull(), F.array(F.lit(None).cast("string"))).otherwise(F.col("several"))
    return read.select("request", "reason", F.posexplode(whole).alias("place", "item"))


def judged(requests: DataFrame) -> DataFrame:
    """Items as columns, with ``reason`` null where they are accepted."""
    out = items(requests)
    text = lambda name: F.get_json_object("item", f"$.{name}")
    out = out.withColumns({"station_id": text("station_id"), "source": text("source"), "adapter": F.coalesce(text("adapter"), F.lit("push"))})
    out = out.withColumn("told_at", text("observed_at")).withColumn("observed_at", F.col("told_at").try_cast("timestamp"))
    told = {c: text(c) for c in CHANNELS}
    number: dict[str, Column] = {c: t.try_cast("double") for c, t in told.items()}
    bad_number = F.coalesce(*[F.when(told[c].isNotNull() & number[c].isNull(), c) for c in CHANNELS])
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.get_json_object("item", "$").isNull() | ~F.get_json_object("item", "$").startswith("{"), "NOT_AN_OBJECT")
        .when(F.col("station_id").isNull() | ~F.col("station_id").rlike(STATION_ID), "BAD_STATION_ID")
        .when(F.col("observed_at").isNull(), "BAD_TIME")
        .when(bad_number.isNotNull(), F.concat(F.lit("BAD_NUMBER:"), bad_number))
    )
    return out.withColumn("reason", reason).select("request", "place", "reason", "station_id", "source", "adapter", "observed_at", *[number[c].alias(c) for c in CHANNELS])


def run_push(spark: SparkSession, requests: DataFrame, accepted: str, rejected: str, progress: str) -> None:
    """Judge what is there in micro-batches; good items and, beside them, bad ones with their reasons.

    Both folders are named by the micro-batch, so that a batch that is tried again writes over itself.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = judged(batch).persist()
        rows.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        rows.where("reason is not null").select("request", "place", "reason").write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        rows.unpersist()

    requests.writeStream.foreachBatch(put).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
