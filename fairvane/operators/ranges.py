"""Running sums and numbers over a whole order, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable


def running(df: DataFrame, keys: list[str], order: list[str], amount: str, name: str = "upto") -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of its ``keys`` up to and with each row.

    Rows are range-partitioned and summed within partitions; what the partitions before hold of a
    key is a window over one row for each partition.  ``order`` must tell the rows of a key apart.
    """
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__part", F.spark_partition_id())
    rows = durable(rows)
    inside = F.sum(amount).over(Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = rows.groupBy("__part", *keys).agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__part", *keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    return rows.withColumn(name, inside).join(carried, ["__part", *keys]).withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")
