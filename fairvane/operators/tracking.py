"""Life of regional events over snapshots: matched, grown, moved, split, merged, gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.physics import haversine_km
from .spatial import associations

MOVED_KM, CHANGED = 125.0, 1.0


def tracked(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Events after one snapshot.

    ``previous`` has event (id), members, lat, lon, magnitude; ``current`` has id and the
    same.  A mutually unique overlap continues an event with the flags that its change
    earns; other clusters open events, noting a merge or an ambiguous split; events
    without an heir disappear.
    """
    links = associations(previous, current)
    kept = links.where("kind = 'CONTINUE'").select(F.col("event"), F.col("cluster"))
    p = previous.select(F.col("id").alias("event"), *[F.col(c).alias(f"p_{c}") for c in ("members", "lat", "lon", "magnitude")])
    c = current.select(F.col("id").alias("cluster"), *[F.col(x).alias(f"c_{x}") for x in ("members", "lat", "lon", "magnitude")])
    moved = haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("c_lat"), F.col("c_lon")) > MOVED_KM
    grown = F.size("c_members") - F.size("p_members")
    change = F.col("c_magnitude") - F.col("p_magnitude")
    flags = F.array_compact(
        F.array(
            F.when(moved, "MOVING"),
            F.when(change >= CHANGED, "INTENSIFYING").when(change <= -CHANGED, "WEAKENING"),
            F.when(grown > 0, "GROWING").when(grown < 0, "SHRINKING"),
        )
    )
    going_on = kept.join(p, "event").join(c, "cluster").select(
        F.concat(F.lit("E"), F.col("event").cast("string")).alias("name"), F.lit("ACTIVE").alias("status"), F.concat_ws(",", flags).alias("flags")
    )
    notes = links.where("kind <> 'CONTINUE'").groupBy("cluster").agg(F.max("kind").alias("note"))
    opened = (
        current.select(F.col("id").alias("cluster"))
        .join(kept, "cluster", "left_anti")
        .join(notes, "cluster", "left")
        .select(F.concat(F.lit("N"), F.col("cluster").cast("string")).alias("name"), F.lit("NEW").alias("status"), F.coalesce("note", F.lit("")).alias("flags"))
    )
    gone = (
        previous.select(F.col("id").alias("event"))
        .join(kept, "event", "left_anti")
        .select(F.concat(F.lit("E"), F.col("event").cast("string")).alias("name"), F.lit("DISAPPEARED").alias("status"), F.lit("").alias("flags"))
    )
    return going_on.unionByName(opened).unionByName(gone)
