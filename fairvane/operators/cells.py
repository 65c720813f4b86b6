"""Nearest neighbours by growing discs, and clusters over cells.

A pair of cells bounds the distance of all pairs of their points from both sides, so cells that lie close
as wholes are linked as wholes.  Only cells at the edge of the reach are split, and only pairs of small
cells are opened into points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_KM
from ..durable import durable
from ..functions.physics import haversine_km
from .discs import band_height, cells_around, column_of
from .discs import nearest as disc_nearest
from .normalise import valid_coordinates

#: A radius that no two points on Earth exceed.
ANYWHERE_KM = 20_100.0
#: Distances are compared in metres; bounds keep clear of their rounding.
METRE = 1e-3


def _west(lon: Column) -> Column:
    """180 degrees east is 180 west."""
    return F.when(lon >= 180, lon - 360).otherwise(lon)


def _box(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Count, centre and reach (all points are within it of the centre) of groups of points."""
    ends = [f(x).alias(f"{n}_{x}") for x in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))]
    out = rows.groupBy(*by).agg(*ends, *more)
    lowest = F.when((F.col("lo_lat") <= 0) & (F.col("hi_lat") >= 0), 0.0).otherwise(F.least(F.abs("lo_lat"), F.abs("hi_lat")))
    along = F.radians((F.col("hi_lat") - F.col("lo_lat")) / 2) + F.radians((F.col("hi_lon") - F.col("lo_lon")) / 2) * F.cos(F.radians(lowest))
    return (
        out.withColumn("lat", (F.col("lo_lat") + F.col("hi_lat")) / 2)
        .withColumn("lon", (F.col("lo_lon") + F.col("hi_lon")) / 2)
        .withColumn("reach", along * EARTH_RADIUS_KM + 1e-6)
    )


def _stored(df: DataFrame) -> DataFrame:
    """``durable``, joined by shuffle: rows of coordinates pack so well in files that a large table looks small enough to broadcast."""
    return durable(df).hint("merge")


def _spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores: each makes many, so few bytes are no reason for few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _apart(q: str = "q", t: str = "t") -> Column:
    return haversine_km(F.col(f"{q}.lat"), F.col(f"{q}.lon"), F.col(f"{t}.lat"), F.col(f"{t}.lon"))


def _bounded(pairs: DataFrame) -> DataFrame:
    """No two points of the cells are nearer than ``near`` or farther than ``far``."""
    both = F.col("q.reach") + F.col("t.reach")
    out = pairs.withColumn("apart", _apart())
    return out.withColumn("near", F.col("apart") - both - METRE).withColumn("far", F.col("apart") + both + METRE).drop("apart")


def nearest(
    points: DataFrame,
    k: int,
    radius_km: float,
    same: tuple[str, ...] = (),
    time_us: str | None = None,
    tolerance_us: int = 0,
    exact: bool = False,
    queries: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` nearest other points of each point (id, neighbour, distance, rank) within the radius.

    Neighbours agree in the columns ``same`` and, with ``time_us``, lie within the tolerance of each
    other in time.  Distances are rounded to metres unless ``exact``; ties go by id.  Points without valid
    coordinates take no part.  A disc grows until it holds ``k`` points and little more
    (``discs.nearest``), so the pairs that are compared grow with the points, not with their square.
    With ``queries`` (ids) only these points are asked for.
    """
    keys = [*same]
    at = F.col(time_us) if time_us else F.lit(0).cast("long")
    rows = points.where(valid_coordinates(F.col("lat"), F.col("lon"))).select("id", "lat", _west(F.col("lon")).alias("lon"), *same, at.alias("at"))
    rows = rows.where("at is not null")
    # Of points that agree in place and time only the first can be among the nearest of any other.
    twins = Window.partitionBy(*keys, "lat", "lon", "at").orderBy("id")
    targets = rows.withColumn("nth", F.row_number().over(twins)).where(F.col("nth") <= k + 1).drop("nth")
    if queries is not None:
        rows = rows.join(queries.select("id").hint("merge"), "id", "left_semi")
    found = disc_nearest(rows, targets, k, radius_km, same, tolerance_us if time_us else None, exact)
    met = found.select("id", "neighbour", (F.col("exact") if exact else F.round("exact", 3)).alias("distance"))
    best = Window.partitionBy("id").orderBy("distance", "neighbour")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest_anywhere(points: DataFrame, k: int, same: tuple[str, ...] = (), start_km: float = 50.0, exact: bool = False) -> DataFrame:
    """``nearest`` without a radius: points whose ring does not close are asked again in one ten times as wide."""
    out, radius, open_ = None, start_km, points.select("id")
    while True:
        found = _stored(nearest(points, k, radius, same, exact=exact, queries=open_))
        closed = found.groupBy("id").count().where(F.col("count") >= k).select("id")
        done = found if radius >= ANYWHERE_KM else found.join(closed.hint("merge"), "id", "left_semi")
        out = done if out is None else out.unionByName(done)
        open_ = _stored(open_.join(closed.hint("merge"), "id", "left_anti"))
        if radius >= ANYWHERE_KM or not open_.limit(1).count():
            return out
        radius = min(10 * radius, ANYWHERE_KM)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition that join what the ones before them have not joined."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = parent[x]
        return x

    for batch in batches:
        kept = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                kept.append((a, b))
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*kept)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """The smallest id reachable (root) of each id of ``links`` (a, b: whole numbers), by large and small stars in turn.

    Tasks first drop links that close a circle among their own.  Every round makes chains about half
    as long, so rounds grow with the logarithm of the widest component; a round is a table in the
    shared folder.
    """
    thin = links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest, "a long, b long")
    edges = durable(thin.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        down = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = edges.select(F.col("v").alias("id")).distinct().withColumn("root", F.col("id"))
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
        seen = now


def clusters(points: DataFrame, eps_km: float, splits: int = 4) -> DataFrame:
    """Components (id, cluster) of the points' graph of distances up to ``eps_km``; lone points have none.

    Small cells are nodes as wholes, since all their points are within reach of each other, and
    cells that lie close as wholes are linked without a look at their points.  Only pairs of cells
    at the edge of the reach that nothing else has joined are split, and at last opened into points.
    """
    grid = eps_km / 4
    rows = points.where(valid_coordinates(F.col("lat"), F.col("lon"))).select("id", "lat", _west(F.col("lon")).alias("lon"))
    side = band_height(eps_km) / 8

    def keyed(rows_: DataFrame, split: int) -> DataFrame:
        high = side / 2**split
        band = F.floor((F.col("lat") + 90) / high)
        edge = F.least(F.abs(band * high - 90), F.abs((band + 1) * high - 90))
        around = F.greatest(F.lit(1.0), F.ceil(360 * F.cos(F.radians(F.when((band * high < 90) & ((band + 1) * high > 90), 0.0).otherwise(edge))) / high))
        return rows_.withColumn("cb", band.cast("long")).withColumn("cc", F.floor((F.col("lon") + 180) / 360 * around).cast("long"))

    placed = durable(keyed(rows, 0))
    cells = durable(_box(placed, ["cb", "cc"], F.min("id").alias("id"), F.count("*").alias("n")).select("cb", "cc", "id", "n", "lat", "lon", "reach"))
    # Cells whose points may be within reach: centres within reach of each other and both cells' own.
    near = nearby_cells(cells.select("id", "lat", "lon", "reach"), eps_km + 2 * grid, eps_km)
    near = durable(near)
    sure = near.where(F.col("far") <= eps_km).select(F.col("q.id").alias("a"), F.col("t.id").alias("b"))
    roots = cells.select("id").join(components(sure), "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.col("root").isNotNull().alias("linked"))
    roots = durable(roots)
    doubt = near.where(F.col("far") > eps_km).select(F.col("q.id").alias("a"), F.col("t.id").alias("b"))
    doubt = _unjoined(doubt, roots)
    members = placed.join(cells.select("cb", "cc", F.col("id").alias("cell")), ["cb", "cc"]).drop("cb", "cc")
    members, found = durable(members), None
    for split in range(1, splits + 1):
        doubt = durable(doubt)
        if not doubt.limit(1).count():
            break
        asked = doubt.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
        boxes = durable(_box(keyed(members.join(asked, "cell"), split), ["cell", "cb", "cc"]).select("cell", "lat", "lon", "reach"))
        side_of = lambda x, name: boxes.select(F.col("cell").alias(x), F.struct("lat", "lon", "reach").alias(name))  # noqa: E731,B023
        parts = _bounded(doubt.join(side_of("a", "q"), "a").join(side_of("b", "t"), "b")).where(F.col("near") <= eps_km)
        judged = durable(parts.groupBy("a", "b").agg(F.min("far").alias("far")))
        close = judged.where(F.col("far") <= eps_km).select("a", "b")
        found = close if found is None else found.unionByName(close)
        doubt = judged.where(F.col("far") > eps_km).select("a", "b")
    ends = [members.select(F.col("cell").alias(c), F.struct("lat", "lon").alias(s)) for c, s in (("a", "q"), ("b", "t"))]
    met = doubt.join(ends[0], "a").join(ends[1], "b").where(_apart() <= eps_km).select("a", "b").distinct()
    found = met if found is None else found.unionByName(met)
    # What the edges join are components of whole cells, which are few.
    by_root = roots.select("id", "root")
    found = found.join(by_root.withColumnsRenamed({"id": "a", "root": "ra"}), "a").join(by_root.withColumnsRenamed({"id": "b", "root": "rb"}), "b")
    joined = components(durable(found.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
    label = roots.join(joined.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left")
    label = label.join(cells.select("id", "n"), "id").where((F.col("n") > 1) | F.col("linked") | F.col("top").isNotNull())
    label = label.select(F.col("id").alias("cell"), F.coalesce("top", "root").alias("cluster"))
    return members.join(label, "cell").select("id", "cluster")


def nearby_cells(cells: DataFrame, within_km: float, eps_km: float) -> DataFrame:
    """Pairs of cells (structs q and t, each pair once) some of whose points may be within ``eps_km``."""
    height = band_height(within_km)
    band = F.floor((F.col("lat") + 90) / height).cast("long")
    node = F.struct("id", "lat", "lon", "reach")
    n = cells_around(F.col("tb"), within_km)
    q = _spread(cells).select(node.alias("q"), F.explode(F.sequence(band - 1, band + 1)).alias("tb"))
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(column_of(F.col("q.lon"), n) + d, n)))
    q = q.withColumn("tc", F.explode(around))
    t = cells.select(node.alias("t"), band.alias("tb"), column_of(F.col("lon"), cells_around(band, within_km)).alias("tc"))
    return _bounded(q.join(t, ["tb", "tc"]).where("q.id < t.id").drop("tb", "tc")).where(F.col("near") <= eps_km)


def _unjoined(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends nothing has joined yet."""
    roots = roots.select("id", "root")
    ends = pairs.join(roots.withColumnsRenamed({"id": "a", "root": "ra"}), "a").join(roots.withColumnsRenamed({"id": "b", "root": "rb"}), "b")
    return ends.where("ra <> rb").select("a", "b")
