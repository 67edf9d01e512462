"""Exact global ranks and running sums without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import durable


def running_sum(frame: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows before this one in `order`.

    Rows are dealt by range and kept, so that partition numbers follow the order; one total per partition (as many
    rows as partitions) gives each its base, and windows run inside partitions only. `order` must have no ties.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    ranged = frame.withColumn("__v", value.cast("bigint")).repartitionByRange(*order).withColumn("__pid", F.spark_partition_id())
    ranged = durable(ranged)
    base = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__pid").agg(F.sum("__v").alias("__t"))
    bases = totals.select("__pid", F.coalesce(F.sum("__t").over(base), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(F.broadcast(bases), "__pid")  # one row per partition
        .withColumn(out, F.col("__base") + F.coalesce(F.sum("__v").over(inside), F.lit(0)))
        .drop("__pid", "__v", "__base", *keys)
    )


def number_rows(frame: DataFrame, order: list[Column], out: str, start: int = 0) -> DataFrame:
    """Adds dense row numbers in `order`, from `start`."""
    numbered = running_sum(frame, order, F.lit(1), out)
    return numbered.withColumn(out, F.col(out) + start) if start else numbered
