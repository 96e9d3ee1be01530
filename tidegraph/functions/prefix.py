"""Running totals over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.session import cut, task_count


def running_totals(df: DataFrame, order: list, values: list[str]) -> DataFrame:
    """df with cum_<value> for each value column, in the given total order.

    Rows are range-partitioned by the order and summed inside each range; the ranges' totals (one row for each
    partition) give the offsets. No task sees more than its range.
    """
    ranged = cut(df.repartitionByRange(task_count(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *(F.sum(v).over(w).alias(f"cum_{v}") for v in values))
    totals = ranged.groupBy("_range").agg(*(F.sum(v).alias(v) for v in values))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = totals.select("_range", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_o_{v}") for v in values))
    joined = local.join(F.broadcast(offsets), "_range")
    return joined.select(*df.columns, *((F.col(f"cum_{v}") + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values))
