"""Places in one order of a whole frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Rows up to which one task orders a frame.
ONE_TASK = 100_000


def placed(df: DataFrame, order: list[Column], name: str = "place", one_task: int = ONE_TASK) -> DataFrame:
    """df with each row's place, from 0, in a total order.

    A large frame is dealt out by ranges of the order; each range numbers its own
    rows, and the counts of the ranges, one number each, give where they begin.
    """
    if df.limit(one_task + 1).count() <= one_task:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + inside).drop("_range", "_start")
