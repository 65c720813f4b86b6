"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Only where that is unset and all
    tasks run on this machine (a local master), a temporary folder takes its place.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    own = spark.conf.get("fairvane.local.checkpoint.dir", None)
    if own is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="fairvane-")
        spark.conf.set("fairvane.local.checkpoint.dir", own)
    return own


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of the table, never a
    second run of what produced it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """A text column with null taken as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_remainder(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus


def as_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that an operator's own columns clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def row_columns(docs: DataFrame, row: str = "row") -> list[Column]:
    """The columns of ``docs`` out of the struct that ``as_row`` made."""
    return [F.col(row).getField(c).alias(c) for c in docs.columns]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it.

    Filters and projections inline columns where they use them; an inlined chain of
    columns that each use the last one several times would grow without bound.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constants(values: list, kind: str) -> Column:
    """A constant array as one literal, however long (made from its text when the plan is optimised)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
