"""Cutting lineage, and tables of one's own, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in ``spark.checkpoint.dir``; on a local master without it, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("fairvane.checkpoint.set", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fairvane-")  # tests on one machine
        spark.conf.set("fairvane.checkpoint.set", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Lost executors cost a read, not a rerun, and the planner sees the size of the files: the
    estimate of a checkpoint grows with every join that led to it, without end in a loop.
    """
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
