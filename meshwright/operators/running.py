"""Running sums and ordinals over whole tables without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import write_table


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows before, in order. Rows are dealt by ranges; only one sum per range is added up in one task, and there
    are as many of these as the session has shuffle partitions. Ties share a range; among them the order is any."""
    ranged = write_table(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    ahead = sums.select("_range", F.coalesce(F.sum("_sum").over(before().orderBy("_range")), F.lit(0)).alias("_ahead"))
    within = F.coalesce(F.sum("_value").over(before("_range").orderBy(*order)), F.lit(0))
    return ranged.withColumn("_within", within).join(F.broadcast(ahead), "_range").withColumn(name, F.col("_ahead") + F.col("_within")).drop("_range", "_value", "_within", "_ahead")


def ordinals(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the number of each row in order, from 0."""
    return running_total(df, order, F.lit(1).cast("long"), name)
