"""A log of events with ids that only grow, replay from any id, and retention by date.

A micro-batch becomes one folder of the log, named by its batch id, and one row of the heads: its
first and last event id.  Ids go on from the batches before, in the order of the rows, so a batch
that is tried again writes the same rows with the same ids over the first try.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import running

#: Events that a reader may be behind before it must take a snapshot instead.
RING = 2000


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # nothing is there before the first batch
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def append_batch(events: DataFrame, batch_id: int, path: str, order: list[str]) -> None:
    """foreachBatch sink.  ``order`` tells the batch's rows apart and gives their order."""
    spark = events.sparkSession
    heads = _read(spark, f"{path}/heads")
    base = 0
    if heads is not None:
        base = heads.where(F.col("batch") < batch_id).agg(F.max("last")).first()[0] or 0
    numbered = running(events.withColumn("__one", F.lit(1).cast("long")), [], order, "__one", "id").drop("__one")
    numbered.withColumn("id", F.col("id") + base).write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")
    written = spark.read.parquet(f"{path}/events/batch={batch_id}")
    head = written.agg(F.coalesce(F.min("id"), F.lit(base)).alias("first"), F.coalesce(F.max("id"), F.lit(base)).alias("last"))
    head.write.mode("overwrite").parquet(f"{path}/heads/batch={batch_id}")  # the batch counts from here on


def run_log(source: DataFrame, path: str, progress: str, order: list[str]) -> None:
    """Append what is there and stop."""
    writer = source.writeStream.foreachBatch(lambda batch, i: append_batch(batch, i, path, order))
    writer.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def replay(spark: SparkSession, path: str, after: int, ring: int = RING) -> tuple[DataFrame, bool]:
    """Events after an id, and whether the reader is so far behind that it must resynchronise.

    Then the events are those that the ring still holds.  Only folders of batches with a head are read,
    and only those that reach beyond the id.
    """
    heads = spark.read.parquet(f"{path}/heads")
    last = heads.agg(F.max("last")).first()[0] or 0
    resync = after < last - ring
    start = max(after, last - ring)
    batches = heads.where(F.col("last") > start).select("batch")
    events = spark.read.parquet(f"{path}/events")
    return events.join(F.broadcast(batches), "batch", "left_semi").where(F.col("id") > start), resync


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def recover(spark: SparkSession, path: str) -> None:
    """Put back a date that a killed run had moved aside, and drop what it left."""
    fs, Path = _files(spark, path)
    for status in list(fs.listStatus(Path(path))) if fs.exists(Path(path)) else []:
        name = status.getPath().getName()
        if name.startswith("_aside-"):
            date = name.split("-", 1)[1].rsplit("-", 1)[0]
            if not fs.exists(Path(f"{path}/{date}")):
                fs.rename(status.getPath(), Path(f"{path}/{date}"))
            else:
                fs.delete(status.getPath(), True)
        elif name.startswith("_edge-"):
            fs.delete(status.getPath(), True)


def retain(spark: SparkSession, path: str, time: str, cutoff: str) -> None:
    """Delete rows before ``cutoff`` from a table that is partitioned by ``date``.

    Whole dates are dropped as folders.  The date of the cutoff is written anew beside the table and
    swapped in; a run that is killed leaves the old rows in place or aside, where ``recover`` finds them.
    """
    recover(spark, path)
    fs, Path = _files(spark, path)
    day = cutoff[:10]
    for status in list(fs.listStatus(Path(path))):
        name = status.getPath().getName()
        if name.startswith("date=") and name[5:] < day:
            fs.delete(status.getPath(), True)
    edge = f"{path}/date={day}"
    if not fs.exists(Path(edge)):
        return
    mark = uuid.uuid4().hex
    spark.read.parquet(edge).where(F.col(time) >= F.lit(cutoff).cast("timestamp")).write.parquet(f"{path}/_edge-{mark}")
    fs.rename(Path(edge), Path(f"{path}/_aside-date={day}-{mark}"))
    fs.rename(Path(f"{path}/_edge-{mark}"), Path(edge))
    fs.delete(Path(f"{path}/_aside-date={day}-{mark}"), True)
