"""Dense numbers in a global order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspan.plans.scratch import save


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """Adds the place of each row, from `first`, in the order of the given columns, which must be a key.

    Rows are dealt into ranges of the order; each range is numbered on its own, from where those before
    it end. Only the ranges' counts, one for each task, are gathered.
    """
    dealt = save(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_range", (F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (first - 1)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + nth).cast("long")).drop("_range", "_before")


def running(rows: DataFrame, group: str, order: str, amount: str, name: str) -> DataFrame:
    """Adds the sum of `amount` over all rows before each row, in the order of group and then order.

    Sums run within a group; groups, few as they are files, start where those before them end.
    """
    totals = rows.groupBy(group).agg(F.sum(amount).alias("_total"))
    ahead = F.coalesce(F.sum("_total").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(group, ahead.alias("_ahead"))
    within = F.coalesce(F.sum(amount).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_within", within).join(totals, group).withColumn(name, (F.col("_ahead") + F.col("_within")).cast("long")).drop("_within", "_ahead")
