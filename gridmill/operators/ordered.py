"""Row numbers and running sums over a whole table, without a single-task window.

Rows are range-partitioned by the order and sorted within partitions; each
partition's totals are few (one row a partition), so their running sums are
broadcast and added to the sums within partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.checkpoints import saved


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with row numbers 1..N in ``order`` (which should be total)."""
    parts = _parts(df, order)
    local = Window.partitionBy("_part").orderBy(*order)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    return parts.join(F.broadcast(_before(sizes)), "_part").withColumn(name, F.col("_before") + F.row_number().over(local)).drop("_part", "_before")


def running_sum(df: DataFrame, value: Column, *order: Column, name: str = "running") -> DataFrame:
    """``df`` with the sum of ``value`` up to and including each row in ``order``."""
    parts = _parts(df.withColumn("_v", value), order)
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy("_part").agg(F.sum("_v").alias("_n"))
    return parts.join(F.broadcast(_before(sums)), "_part").withColumn(name, F.col("_before") + F.sum("_v").over(local)).drop("_part", "_before", "_v")


def _parts(df: DataFrame, order: tuple[Column, ...]) -> DataFrame:
    """The partitions are written down, so that all later reads agree on them."""
    return saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _before(totals: DataFrame) -> DataFrame:
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    return totals.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))


def quantile(df: DataFrame, value: str, q: float, name: str = "quantile") -> DataFrame:
    """One row: the exact quantile, interpolated between neighbours, of the values that are there.

    Equal values are counted first, so a very common one is a single row, and the two
    neighbours are found by running sums of the counts: no task holds all distinct values.
    """
    values = df.select(F.col(value).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    upto = running_sum(values, F.col("c"), F.asc("v"), name="upto")
    size = upto.agg(F.sum("c").alias("n"))  # one row
    place = F.lit(q) * (F.col("n") - 1)
    holds = lambda rank: (F.col("upto") - F.col("c") < rank) & (rank <= F.col("upto"))
    near = upto.crossJoin(F.broadcast(size)).filter(holds(F.floor(place) + 1) | holds(F.ceil(place) + 1))
    return near.agg((F.min("v") + (F.max("v") - F.min("v")) * F.max(place - F.floor(place))).alias(name))
