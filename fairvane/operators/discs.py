"""What lies within a radius of each point, without a list of all pairs.

Points are dealt to tiles of the Earth, each with all points in reach of it; a tile with many points is
dealt in blocks, whose answers add up.  Inside a block points lie in strips of latitude, sorted by
longitude: of each strip a disc surely holds one run, and only points at its edge are looked at one by one.
So the work for a disc grows with its width, not with the points in it, and the memory of a task with the block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_KM
from .normalise import valid_coordinates

#: Rows of a block that ask and that are asked; a tile is twice the radius wide, and at least this.
ASKING, ASKED, TILE_KM = 20_000, 300_000, 100.0
#: Pairs that are held at a time.
AT_ONCE = 2_000_000


def band_height(radius_km: float) -> float:
    """Degrees of latitude that the radius spans, and a little more."""
    return math.degrees(radius_km / EARTH_RADIUS_KM) * 1.0001


def cells_around(band: Column, radius_km: float) -> Column:
    """How many cells a band of latitude has; each is at least the radius wide."""
    if radius_km >= EARTH_RADIUS_KM * math.pi / 2:
        return F.lit(1).cast("long")
    height = band_height(radius_km)
    edge = F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90))
    # Longitude a great circle of the radius can span at this latitude.
    reach = F.lit(math.sin(radius_km / EARTH_RADIUS_KM)) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9))
    width = F.when(reach >= 1, 360.0).otherwise(F.degrees(F.asin(F.least(reach, F.lit(1.0)))) * 1.0001)
    return F.greatest(F.lit(1), F.floor(360 / width)).cast("long")


def column_of(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * cells), cells).cast("long")


def met(asking: DataFrame, asked: DataFrame, radius_km: float, same: tuple[str, ...], kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, asked_at_once: int | None = ASKED) -> DataFrame:
    """``kernel`` over blocks of ``asking`` and of the ``asked`` in their reach; both have lat, lon and ``same``.

    Rows with invalid coordinates or a null in ``same`` take no part.  A row that asks gets an answer of each
    block, or one of all that its tile can reach without ``asked_at_once``.
    """
    tile = max(TILE_KM, 2 * radius_km)
    high, fit = band_height(tile), valid_coordinates(F.col("lat"), F.col("lon"))
    for x in same:
        fit = fit & F.col(x).isNotNull()
    band = lambda lat: F.floor((lat + 90) / high).cast("long")
    q = asking.where(fit).withColumn("__band", band(F.col("lat")))
    q = q.withColumn("__col", column_of(F.col("lon"), cells_around(F.col("__band"), tile)))
    angle = min(radius_km / EARTH_RADIUS_KM, math.pi)
    lift = math.degrees(angle) * 1.0001 + 1e-9
    t = asked.where(fit).withColumn("__band", F.explode(F.sequence(band(F.greatest(F.col("lat") - lift, F.lit(-90.0))), band(F.least(F.col("lat") + lift, F.lit(90.0))))))
    share = F.lit(math.sin(min(angle, math.pi / 2))) / F.greatest(F.cos(F.radians("lat")), F.lit(1e-12))
    polar = (F.abs("lat") + lift >= 90) | (share >= 1)
    span = F.when(polar, 361.0).otherwise(F.degrees(F.asin(F.least(share, F.lit(1.0)))) * 1.0001 + 1e-9)
    n = cells_around(F.col("__band"), tile)
    first, last = (F.floor((F.col("lon") + s * span + 180) / 360 * n).cast("long") for s in (-1, 1))
    columns = F.when(last - first >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.transform(F.sequence(first, last), lambda x: F.pmod(x, n)))
    t = t.withColumn("__col", F.explode(columns))
    tiles = [*same, "__band", "__col"]
    parts = lambda rows, most, name: rows.groupBy(*tiles).agg(F.ceil(F.count("*") / most).alias(name))
    sizes = parts(q, ASKING, "__nq").join(parts(t, asked_at_once or 1 << 62, "__nt").hint("merge"), tiles, "left").fillna(1, ["__nt"])
    row = lambda rows: F.xxhash64(*[c for c in rows.columns if not c.startswith("__")])
    each = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1))
    q_row, t_row = row(q), row(t)
    q = q.join(sizes.hint("merge"), tiles).withColumn("__q", F.pmod(q_row, F.col("__nq"))).withColumn("__t", each("__nt")).drop("__nq", "__nt")
    t = t.join(sizes.hint("merge"), tiles).withColumn("__t", F.pmod(t_row, F.col("__nt"))).withColumn("__q", each("__nq")).drop("__nq", "__nt")
    spark = asking.sparkSession
    # Blocks make much work from few bytes, so they are spread over all cores by number.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = [*tiles, "__q", "__t"]
    # New names of the columns, since both sides may come from one table.
    dealt = [rows.select([F.col(c).alias(c) for c in rows.columns]).repartition(tasks, *block).groupBy(*block) for rows in (q, t)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(kernel, schema)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def distance(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """``haversine_km`` of arrays."""
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0.0, 1 - a)))


def runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which run (start to end, exclusive) each place is of, and the place, for all places of all runs."""
    sizes = np.maximum(end - start, 0)
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)


def slices(sizes: np.ndarray, most: int = AT_ONCE) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to ``most`` or less, or that are of one."""
    total, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield slice(at, end)
        at = end


def crosses(lat: np.ndarray, lon: np.ndarray, radius_km: float) -> bool:
    """Whether a disc around one of the points may reach the date line."""
    angle = radius_km / EARTH_RADIUS_KM
    share = math.sin(min(angle, math.pi / 2)) / np.maximum(np.cos(np.radians(lat)), 1e-12)
    polar = (share >= 0.999) | (np.abs(lat) + math.degrees(angle) >= 89.9)
    span = np.where(polar, 180.0, np.degrees(np.arcsin(np.minimum(share, 1.0))) + 1e-3)
    return bool((np.abs(lon) + span >= 180).any())


class Strips:
    """Points by strips of latitude and by longitude; ``rows`` are their places in what was given.

    With ``around`` each point is held twice, so that a run around the date line is one.
    """

    def __init__(self, lat: np.ndarray, lon: np.ndarray, around: bool):
        rows, lon = np.arange(len(lat)), np.where(lon >= 180, lon - 360, lon)
        if around:
            rows, lat, lon = np.concatenate([rows, rows]), np.concatenate([lat, lat]), np.concatenate([lon, np.where(lon < 0, lon + 360, lon - 360)])
        levels, strip = np.unique(lat, return_inverse=True)
        most = int(2 * math.sqrt(2 * len(lat))) + 16
        if len(levels) > 2 * most:
            strip = np.empty(len(lat), int)
            strip[np.argsort(lat, kind="stable")] = np.arange(len(lat)) * most // max(1, len(lat))
        order = np.lexsort((lon, strip))
        self.rows, self.lat, self.lon, strip = rows[order], lat[order], lon[order], strip[order]
        self.key = strip * 1024.0 + self.lon
        first = np.flatnonzero(np.diff(strip, prepend=-1))
        self.strip = strip[first]
        self.low, self.high = (f.reduceat(self.lat, first) for f in (np.minimum, np.maximum)) if len(first) else (np.zeros(0), np.zeros(0))

    def runs(self, lat: np.ndarray, lon: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For slices of discs: disc, and its run in a strip: outer start, sure start, sure end, outer end."""
        lift = np.degrees(radius / EARTH_RADIUS_KM) + 1e-7
        first, last = np.searchsorted(self.high, lat - lift), np.searchsorted(self.low, lat + lift, "right")
        for part in slices(last - first):
            disc, s = runs(first[part], last[part])
            disc += part.start
            if len(disc):
                yield disc, *self._run(s, lat[disc], np.where(lon >= 180, lon - 360, lon)[disc], radius[disc])

    def _run(self, s: np.ndarray, lat: np.ndarray, lon: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, ...]:
        low, high, angle = self.low[s], self.high[s], np.minimum(radius / EARTH_RADIUS_KM, math.pi)
        half, here = np.sin(angle / 2) ** 2, np.cos(np.radians(lat))

        def share(at: np.ndarray) -> np.ndarray:
            return (half - np.sin(np.radians(at - lat) / 2) ** 2) / np.maximum(here * np.cos(np.radians(at)), 1e-15)

        ends = share(low), share(high)
        least, most = np.minimum(*ends) - 1e-13, np.maximum(*ends) + 1e-13
        if len(self.key) and (high > low).any():
            # The disc is widest where its edge touches a meridian.
            top = np.sin(np.radians(lat)) / np.where(np.abs(np.cos(angle)) < 1e-12, 1e-12, np.cos(angle))
            widest = np.degrees(np.arcsin(np.clip(top, -1, 1)))
            inside = (widest > low) & (widest < high)
            most = np.where(inside, np.maximum(most, share(widest) + 1e-13), most)
            most = np.where((angle >= math.pi / 2) & (high > low), 2.0, most)
        reach = lambda x: np.degrees(2 * np.arcsin(np.sqrt(np.clip(x, 0, 1))))
        sure = np.where(least < 0, -1.0, np.where(least >= 1, 180.0, reach(least) - 1e-7))
        outer = np.where(most < 0, -1.0, np.minimum(180.0, reach(most) + 1e-7))
        at = self.strip[s] * 1024.0
        around = lambda d: (np.searchsorted(self.key, at + lon - d), np.searchsorted(self.key, at + lon + d))
        a, d = around(np.maximum(outer, 0))
        b, c = around(np.maximum(sure, 0)) if (sure != outer).any() else (a, d)
        d, none = np.where(outer < 0, a, d), (sure < 0) | (outer < 0)
        b, c = np.clip(np.where(none, d, b), a, d), np.clip(np.where(none, d, c), a, d)
        return a, b, c, d

    def parts(self, lat: np.ndarray, lon: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """disc, start and end of runs that lie in discs as wholes; points at an edge are runs of one."""
        for disc, a, b, c, d in self.runs(lat, lon, radius):
            held = c > b
            yield disc[held], b[held], c[held]
            edge = np.concatenate([disc, disc]), np.concatenate([a, c]), np.concatenate([b, d])
            some = edge[2] > edge[1]
            discs_, start, end = (x[some] for x in edge)
            for part in slices(end - start):
                of, at = runs(start[part], end[part])
                of = discs_[part][of]
                inside = distance(lat[of], lon[of], self.lat[at], self.lon[at]) <= radius[of]
                yield of[inside], at[inside], at[inside] + 1

    def sums(self, lat: np.ndarray, lon: np.ndarray, radius: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The sum of the points' whole weights in each disc."""
        before, out = np.concatenate([[0], np.cumsum(weights[self.rows])]), np.zeros(len(lat), np.int64)
        for disc, start, end in self.parts(lat, lon, radius):
            np.add.at(out, disc, before[end] - before[start])
        return out


class Ranks:
    """Wavelet matrix: how many of a run are below a rank, and the k-th smallest of several runs."""

    def __init__(self, ranks: np.ndarray):
        self.size, self.levels, v = len(ranks), max(1, int(ranks.max(initial=0)).bit_length()), ranks
        self.zeros = []
        for level in reversed(range(self.levels)):
            one = (v >> level) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            v = np.concatenate([v[~one], v[one]])

    def below(self, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
        whole, out = end - start, np.zeros(len(start), np.int64)
        for i, zeros in enumerate(self.zeros):
            one, a, b = (rank >> (self.levels - 1 - i)) & 1 == 1, zeros[start], zeros[end]
            out += np.where(one, b - a, 0)
            start, end = np.where(one, zeros[-1] + start - a, a), np.where(one, zeros[-1] + end - b, b)
        return np.where(rank >= 1 << self.levels, whole, out)

    def kth(self, of: np.ndarray, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest rank (from 0) over the runs ``of`` each asker."""
        out, k = np.zeros(len(k), np.int64), k.astype(np.int64).copy()
        for i, zeros in enumerate(self.zeros):
            a, b = zeros[start], zeros[end]
            count = np.bincount(of, b - a, len(k)).astype(np.int64)
            one = k >= count
            k, out = np.where(one, k - count, k), (out << 1) | one
            up = one[of]
            start, end = np.where(up, zeros[-1] + start - a, a), np.where(up, zeros[-1] + end - b, b)
        return out


def counts(points: DataFrame, radius_km: float, same: tuple[str, ...] = (), time_us: str | None = None, tolerance_us: int = 0) -> DataFrame:
    """``points`` by place (lat, lon, ``same`` and the time): n points there, and ``near`` points within the radius, these included.

    With ``time_us`` only points within the tolerance of each other in time count.
    """
    fit = valid_coordinates(F.col("lat"), F.col("lon"))
    places = points.where(fit).withColumn("at", F.col(time_us) if time_us else F.lit(0).cast("long")).where("at is not null")
    places = places.groupBy("lat", "lon", *same, "at").agg(F.count("*").alias("n"))

    def kernel(q: pa.Table, t: pa.Table) -> pa.Table:
        near = np.zeros(len(q), np.int64)
        if len(q) and len(t):
            lat, lon, radius = numbers(q, "lat"), numbers(q, "lon"), np.full(len(q), float(radius_km))
            around = crosses(lat, lon, radius_km)
            strips, n = Strips(numbers(t, "lat"), numbers(t, "lon"), around), numbers(t, "n")
            if not time_us:
                near = strips.sums(lat, lon, radius, n)
            else:
                times, at = np.repeat(numbers(t, "at"), n), numbers(q, "at")
                strips = Strips(np.repeat(numbers(t, "lat"), n), np.repeat(numbers(t, "lon"), n), around)
                levels, rank = np.unique(times, return_inverse=True)
                ranks = Ranks(rank[strips.rows])
                low, high = np.searchsorted(levels, at - tolerance_us), np.searchsorted(levels, at + tolerance_us, "right")
                for disc, start, end in strips.parts(lat, lon, radius):
                    np.add.at(near, disc, ranks.below(start, end, high[disc]) - ranks.below(start, end, low[disc]))
        return pa.table([q.column(c) for c in keep] + [pa.array(near)], names=[*keep, "near"])

    keep = ["lat", "lon", *same, "at", "n"]
    types = {f.name: f.dataType.simpleString() for f in places.schema.fields}
    found = met(places, places, radius_km, same, kernel, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", near long")
    return found.groupBy("lat", "lon", *same, "at").agg(F.first("n").alias("n"), F.sum("near").alias("near"))


def order_statistics(points: DataFrame, value: str, radius_km: float) -> DataFrame:
    """id, n, low, median (the upper one) and high of ``value`` over the other points within the radius; nulls don't count.

    Ids are those of single points.  A block holds all that its tile can reach, so that ranks are exact.
    """
    keep = points.select("id", "lat", "lon", F.col(value).cast("double").alias("v"))

    def kernel(q: pa.Table, t: pa.Table) -> pa.Table:
        size = len(q)
        n, ends = np.zeros(size, np.int64), [np.full(size, np.nan) for _ in range(3)]
        if size and len(t):
            lat, lon, radius = numbers(q, "lat"), numbers(q, "lon"), np.full(size, float(radius_km))
            strips = Strips(numbers(t, "lat"), numbers(t, "lon"), crosses(lat, lon, radius_km))
            levels, rank = np.unique(numbers(t, "v"), return_inverse=True)
            ranks = Ranks(rank[strips.rows])
            own = q.column("v").to_numpy(zero_copy_only=False).astype(float)
            has = ~np.isnan(own)
            mine = np.searchsorted(levels, own)
            width = np.searchsorted(strips.low, lat + np.degrees(radius / EARTH_RADIUS_KM), "right") - np.searchsorted(strips.high, lat - np.degrees(radius / EARTH_RADIUS_KM))
            for part in slices(np.maximum(width, 1), AT_ONCE // 2):
                got = [np.concatenate(x) for x in zip(*strips.parts(lat[part], lon[part], radius[part]))] or [np.zeros(0, int)] * 3
                of, start, end = got
                count = np.bincount(of, end - start, part.stop - part.start).astype(np.int64)
                others = count - has[part]

                def nth(k: np.ndarray) -> np.ndarray:
                    """The k-th of the others: past the own value one further on."""
                    found = ranks.kth(of, start, end, k)
                    shift = has[part] & (found >= mine[part])
                    return np.where(shift, ranks.kth(of, start, end, np.minimum(k + 1, np.maximum(count - 1, 0))), found) if shift.any() else found

                n[part] = others
                some = others > 0
                for out, k in zip(ends, (0 * others, others // 2, others - 1)):
                    at = nth(np.where(some, k, 0))
                    out[part] = np.where(some, levels[np.minimum(at, len(levels) - 1)], np.nan)
        return pa.table([q.column("id"), pa.array(n)] + [pa.array(x, from_pandas=True) for x in ends], names=["id", "n", "low", "median", "high"])

    kind = points.schema["id"].dataType.simpleString()
    return met(keep, keep.where("v is not null"), radius_km, (), kernel, f"id {kind}, n long, low double, median double, high double", None)


def nearest(rows: DataFrame, targets: DataFrame, k: int, radius_km: float, same: tuple[str, ...], tolerance_us: int | None, exact: bool) -> DataFrame:
    """id, neighbour, exact distance: the ``k`` nearest targets of each row, of each block that it meets.

    Both have id, lat, lon, ``same`` and at (microseconds).  A disc grows or shrinks until it holds little
    more than is asked for, and only then are its points compared.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def kernel(q: pa.Table, t: pa.Table) -> pa.Table:
        mine, theirs = (x.column("id").to_numpy(zero_copy_only=False) for x in (q, t))
        found = _nearest(
            [numbers(q, x) for x in ("lat", "lon", "at")], [numbers(t, x) for x in ("lat", "lon", "at")], *_ranked(mine, theirs), k, float(radius_km), tolerance_us, exact
        )
        of, at, km = found
        return pa.table([q.column("id").take(pa.array(of)), t.column("id").take(pa.array(at)), pa.array(km)], names=["id", "neighbour", "exact"])

    keep = ["id", "lat", "lon", *same, "at"]
    return met(rows.select(*keep), targets.select(*keep), radius_km, same, kernel, f"id {kind}, neighbour {kind}, exact double")


def _ranked(mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rank = np.unique(np.concatenate([mine, theirs]), return_inverse=True)[1]
    return rank[: len(mine)], rank[len(mine) :]


def _nearest(q: list[np.ndarray], t: list[np.ndarray], q_id: np.ndarray, t_id: np.ndarray, k: int, most_km: float, tolerance: int | None, exact: bool) -> tuple[np.ndarray, ...]:
    """Row that asks, target and distance; ties (of metres, unless ``exact``) go by id."""
    (lat, lon, at), empty = q, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if not len(lat) or not len(t_id):
        return empty
    strips = Strips(t[0], t[1], crosses(lat, lon, most_km))
    one, out = np.ones(len(t_id), np.int64), [empty]
    # A guess from the mean density; few rounds correct it where points lie closer or farther.
    area = math.radians(np.ptp(t[0]) + 0.1) * math.radians(np.ptp(t[1]) + 0.1) * EARTH_RADIUS_KM**2 * max(0.02, math.cos(math.radians(float(np.mean(t[0])))))
    radius = np.full(len(lat), min(most_km, math.sqrt(3 * (k + 1) * area / len(t_id) / math.pi)))
    low, high, wanted, tries = np.zeros(len(lat)), np.full(len(lat), np.inf), np.full(len(lat), k + 1), np.zeros(len(lat), int)
    left = np.arange(len(lat))
    while len(left):
        held = strips.sums(lat[left], lon[left], radius[left], one)
        few = (held < wanted[left]) & (radius[left] < most_km)
        many = (held > 6 * wanted[left] + 16) & (radius[left] - low[left] > 1e-4) & (tries[left] < 60)
        fit = left[~few & ~many]
        enough = [np.zeros(0, int)]
        for part in slices(held[~few & ~many] + 1):
            who = fit[part]
            of, place = [], []
            for disc, start, end in strips.parts(lat[who], lon[who], radius[who]):
                i, p = runs(start, end)
                of.append(disc[i])
                place.append(strips.rows[p])
            of, place = (np.concatenate(x) if x else np.zeros(0, int) for x in (of, place))
            row = who[of]
            other = q_id[row] != t_id[place]
            if tolerance is not None:
                other &= np.abs(at[row] - t[2][place]) <= tolerance
            row, place = row[other], place[other]
            km = distance(lat[row], lon[row], t[0][place], t[1][place])
            near = km <= most_km
            row, place, km = row[near], place[near], km[near]
            # What lies within a metre of the edge may tie with what lies beyond it.
            inner = np.bincount(row[km <= radius[row] - 0.002], minlength=len(lat))[who]
            done = (inner >= k) | (radius[who] >= most_km)
            enough.append(who[done])
            order = np.lexsort((t_id[place], km if exact else np.floor(km * 1000 + 0.5), row))
            row, place, km = row[order], place[order], km[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            right = np.zeros(len(lat), bool)
            right[who[done]] = True
            take = (nth < k) & right[row]
            out.append((row[take], place[take], km[take]))
        settled = np.zeros(len(lat), bool)
        settled[np.concatenate(enough)] = True
        short, over = np.zeros(len(lat), bool), np.zeros(len(lat), bool)
        short[left[few]], short[fit] = True, True
        over[left[many]] = True
        again = np.zeros(len(lat), bool)
        again[fit] = True
        wanted = np.where(again & ~settled, wanted * 3, wanted)
        low, high = np.where(short, np.maximum(low, radius), low), np.where(over, radius, np.where(again, np.inf, high))
        grown = np.where(np.isfinite(high), (low + high) / 2, radius * 2 + 0.01)
        radius = np.minimum(np.where(short | over, grown, radius), most_km)
        tries = np.where(short | over, tries + 1, tries)
        left = left[~settled[left]]
    return tuple(np.concatenate(x) for x in zip(*out))
