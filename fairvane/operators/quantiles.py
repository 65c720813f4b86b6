"""Exact quantiles of groups of any size, by selection.

Each wanted rank is a range of values that is sure to hold it.  A pass over the data counts the
values of the open ranges in bins, which partial aggregation shrinks to a few numbers a task, and
each range becomes the bin with the wanted rank, with the least and the largest value that were
seen in it.  After two or three passes few values are left, and counts per distinct value settle
the rank.  No group's values are ever together in one buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable

#: Ranges of at most this many values are settled by their distinct values.
SMALL = 10_000
BINS = 1024


def _even(x: Column) -> Column:
    """A monotone scale on which values of very different size spread over the bins."""
    return F.signum(x) * F.least(F.log1p(F.abs(x)), F.lit(1000.0))  # of infinite ones too


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float | Column], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """For each group its number of values ``n``, and for each name in ``qs`` the quantile, interpolated.

    Null and not-a-number values don't count; groups without others give no row.  Without keys the
    whole table is one group.  A quantile may be an expression of the group's ``n``.
    """
    qs = {name: q if isinstance(q, Column) else F.lit(q) for name, q in qs.items()}
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))  # structs with null fields are equal, so null is a group
    data = durable(df.select(group.alias("g"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)"))
    groups = durable(data.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    wanted = F.array(*[f(q * (F.col("n") - 1)).cast("long") for q in qs.values() for f in (F.floor, F.ceil)])
    ranks = groups.select("g", F.explode(F.array_distinct(wanted)).alias("rank"), F.lit(0).cast("long").alias("base"), "lo", "hi", F.col("n").alias("held"))
    ranks = durable(ranks)
    open_ = (F.col("held") > small) & (F.col("lo") < F.col("hi"))
    while ranks.where(open_).limit(1).count():
        ranges = ranks.where(open_).select("g", "lo", "hi").distinct()
        span = _even(F.col("hi")) - _even(F.col("lo"))
        # Where the scale can't tell a narrow range's ends apart, its plain distances can.
        share = F.coalesce(F.try_divide(_even(F.col("x")) - _even(F.col("lo")), span), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        at = F.least(F.floor(share * bins), F.lit(bins - 1))
        inside = data.join(ranges, "g").where("x between lo and hi").withColumn("bin", F.when(F.col("x") == F.col("lo"), -1).when(F.col("x") == F.col("hi"), bins).otherwise(at))
        counted = inside.groupBy("g", "lo", "hi", "bin").agg(F.count("*").alias("c"), F.min("x").alias("lo2"), F.max("x").alias("hi2"))
        before = Window.partitionBy("g", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("less", F.coalesce(F.sum("c").over(before), F.lit(0)))
        nearer = ranks.where(open_).join(counted, ["g", "lo", "hi"]).where("rank >= base + less and rank < base + less + c")
        nearer = nearer.select("g", "rank", (F.col("base") + F.col("less")).alias("base"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("c").alias("held"))
        ranks = durable(ranks.where(~open_).unionByName(nearer))
    known = ranks.where("lo = hi").select("g", "rank", F.col("lo").alias("x"))
    rest = ranks.where("lo < hi")
    inside = data.join(rest.select("g", "lo", "hi").distinct(), "g").where("x between lo and hi")
    counted = inside.groupBy("g", "lo", "hi", "x").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("g", "lo", "hi").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("upto", F.sum("c").over(upto))
    picked = rest.join(counted, ["g", "lo", "hi"]).where("rank - base >= upto - c and rank - base < upto").select("g", "rank", "x")
    values = known.unionByName(picked).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))  # two ranks a quantile
    out = values.join(groups.select("g", "n"), "g")

    def interpolated(q: Column) -> Column:
        position = q * (F.col("n") - 1)
        low, high = F.floor(position).cast("long"), F.ceil(position).cast("long")
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when(low == high, a).otherwise((high - position) * a + (position - low) * b)

    named = [F.col("g").getField(k).alias(k) for k in keys]
    return out.select(*named, "n", *[interpolated(q).alias(name) for name, q in qs.items()])


def medians(df: DataFrame, keys: list[str], values: list[str], suffix: str = "") -> DataFrame:
    """The median of each column of ``values`` by group, all columns in one selection; null where a group has none."""
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(v).alias("column"), F.col(v).cast("double").alias("value")) for v in values])))
    found = quantiles(long, [*keys, "column"], "value", {"median": 0.5})
    group = F.struct(*keys).alias("g")
    wide = found.groupBy(group).agg(*[F.max(F.when(F.col("column") == v, F.col("median"))).alias(f"{v}{suffix}") for v in values])
    every = df.select(group).distinct().join(wide, "g", "left")
    return every.select(*[F.col("g").getField(k).alias(k) for k in keys], *[f"{v}{suffix}" for v in values])
