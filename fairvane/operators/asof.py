"""The reference value of a place as of a time, with a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reference_as_of(asked: DataFrame, references: DataFrame, key: str, place: list[str], at_s: str, value: str, ttl_s: int, stale_s: int) -> DataFrame:
    """For each row of ``asked`` the last reference of its place at or before its time.

    FRESH within ``ttl_s``, STALE (served while a new one is due) within ``stale_s``; older or none:
    MISSING, with no value.  Of references of one place and time the largest value counts.  Time is
    cut into slots of ``stale_s``; a reference stands in its own slot and the next, so a place with
    very many rows is many groups, and no answer lies outside its slot.
    """
    slot = F.floor(F.col(at_s) / stale_s)
    known = references.groupBy(*place, at_s).agg(F.max(value).alias("__value"))
    known = known.withColumn("__slot", F.explode(F.array(slot, slot + 1))).withColumn("__row", F.lit(0))
    held = F.when(F.col("__row") == 0, F.struct(F.col(at_s).alias("at"), F.col("__value").alias("value")))
    both = asked.select(key, *place, at_s).withColumn("__slot", slot).withColumn("__row", F.lit(1)).unionByName(known, allowMissingColumns=True)
    upto = Window.partitionBy(*place, "__slot").orderBy(at_s, "__row").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last(held, ignorenulls=True).over(upto)).where("__row = 1")
    age = F.col(at_s) - F.col("__last.at")
    state = F.when(age <= ttl_s, "FRESH").when(age <= stale_s, "STALE").otherwise("MISSING")
    out = found.select(key, *place, at_s, F.col("__last.value").alias("reference"), age.alias("age_s"), state.alias("state"))
    return out.withColumns({c: F.when(F.col("state") != "MISSING", F.col(c)) for c in ("reference", "age_s")})
