"""Read models: time buckets, counters, listings, aligned series, evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HUMIDITY_RANGE, PRESSURE_RANGE, TEMPERATURE_RANGE
from .quantiles import quantiles


def time_buckets(obs: DataFrame, since: Column, until: Column, max_points: int) -> DataFrame:
    """Down-sampled history of each station: means, last time, summed rain, count."""
    width = F.greatest(F.lit(1.0), (until - since) / max_points)
    bucket = ((F.col("t") - since) / width).cast("long")
    inside = obs.where((F.col("t") >= since) & (F.col("t") <= until))
    return inside.groupBy("station_id", bucket.alias("bucket")).agg(
        F.avg("temperature").alias("temperature"),
        F.avg("humidity").alias("humidity"),
        F.avg("pressure").alias("pressure"),
        F.avg("wind_speed").alias("wind_speed"),
        F.max("wind_direction").alias("wind_direction"),
        F.sum("rainfall").alias("rainfall"),
        F.max("t").alias("t"),
        F.max("source").alias("source"),
        F.count("*").alias("n"),
    )


def percentile_summary(df: DataFrame, value: str, limit: float) -> DataFrame:
    """Least, largest, quantiles by selection, and the percentage over a limit; one row."""
    names = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    plain = df.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(F.when(F.col(value) > limit, 100.0).otherwise(0.0)).alias("pct_over"))
    both = quantiles(df, [], value, names).select(*names).unionByName(plain, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(x).alias(x) for x in ("min", *names, "max", "pct_over")])


def percentile_quartiles(df: DataFrame, value: str) -> DataFrame:
    """Least, median, upper quartile and largest value; one row."""
    plain = df.agg(F.min(value).alias("nearest"), F.max(value).alias("widest"))
    both = quantiles(df, [], value, {"median": 0.5, "p75": 0.75}).drop("n").unionByName(plain, allowMissingColumns=True)
    return both.agg(*[F.max(x).alias(x) for x in ("nearest", "median", "p75", "widest")])


def confusion(df: DataFrame, predicted: Column, actual: Column, keys: list[str]) -> DataFrame:
    """Counts and rates with zero guards."""
    out = df.groupBy(*keys).agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(~predicted & ~actual).alias("tn"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return out.select(
        "*",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("fpr"),
    )


def correlation(df: DataFrame, keys: list[str], x: str, y: str, least: int = 6) -> DataFrame:
    """Pearson r, rounded, null with few rows or hardly any variance."""
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.corr(x, y).alias("r"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy")
    )
    fit = (F.col("n") >= least) & (F.col("vx") > 1e-12) & (F.col("vy") > 1e-12)
    return out.select(*keys, "n", F.round(F.when(fit, F.col("r")), 3).alias("r"))


def change(obs: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Last value less the first of each station."""
    at = F.struct(*order)
    return obs.where(F.col(value).isNotNull()).groupBy("station_id").agg(
        (F.max_by(value, at) - F.min_by(value, at)).alias("change"), F.count("*").alias("n")
    )


def upper_median(values: Column) -> Column:
    """The upper of the two middle values of an array."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def upper_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The upper of the two middle values of each group, under the value's name.

    From counts per value, which partial sums shrink first; no group's values meet in one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    running = F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    marked = counts.withColumn("running", running).withColumn("total", F.sum("n").over(w))
    return marked.where(F.col("running") > F.floor(F.col("total") / 2)).groupBy(*keys).agg(F.min(value).alias(value))


def spacing_violations(df: DataFrame, key: str, time: str, tie: str, expected_s: float, slack_s: float) -> DataFrame:
    """Rows whose distance from the reading before differs from the expected one by more than the slack."""
    w = Window.partitionBy(key).orderBy(time, tie)
    gap = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))) / 1e6
    return df.withColumn("gap_s", gap).where(F.abs(F.col("gap_s") - expected_s) > slack_s)


def newest(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The newest rows, given in ascending order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(limit).orderBy(*order)


def last_per_key(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def histogram_median(df: DataFrame, keys: list[str], value: str, width: float = 0.1) -> DataFrame:
    """Lower median on a grid, from counts per bin: partial sums shrink the data first."""
    bins = df.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) / width + 0.5).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    running = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    marked = bins.withColumn("running", running).withColumn("total", F.sum("n").over(w))
    return marked.where(F.col("running") * 2 >= F.col("total")).groupBy(*keys).agg(
        (F.min("bin") * width).alias("median"), F.max("total").alias("n")
    )


def ecod(values: DataFrame, channels: list[str]) -> DataFrame:
    """Empirical tail score of each row: sum over channels of the larger -ln tail share.

    Shares come from counts at and below each distinct value, N being one more than the
    fitted rows; the running counts are over distinct values on a grid.
    """
    out = values
    n = values.count() + 1
    for c in channels:
        counts = values.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("m"))
        # Runs over coarse ranges first, so no task sees all distinct values.
        coarse = counts.withColumn("g", F.floor(F.col(c)))
        sums = coarse.groupBy("g").agg(F.sum("m").alias("gm"))
        before = sums.withColumn("ahead", F.coalesce(F.sum("gm").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        total = F.lit(n - 1)
        inside = F.sum("m").over(Window.partitionBy("g").orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        ranks = coarse.join(before, "g").withColumn("below", inside + F.col("ahead"))
        tails = ranks.select(
            c, F.greatest(-F.log((F.col("below") + 1) / n), -F.log((total - F.col("below") + F.col("m") + 1) / n)).alias(f"tail_{c}")
        )
        out = out.join(tails, c, "left")
    score = F.lit(0.0)
    for c in channels:
        score = score + F.coalesce(F.col(f"tail_{c}"), F.lit(0.0))
    return out.withColumn("ecod", score)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def as_geojson(stations: DataFrame) -> DataFrame:
    """One point feature for each station, as JSON text; implausible readings are left out."""
    readings = {"temperature": TEMPERATURE_RANGE, "humidity": HUMIDITY_RANGE, "pressure": PRESSURE_RANGE}
    kept = [F.when(F.col(n).between(*r), F.col(n)).alias(n) for n, r in readings.items() if n in stations.columns]
    feature = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
            F.struct("id", "name", *kept).alias("properties"),
        )
    )
    return stations.select("id", feature.alias("feature"))
