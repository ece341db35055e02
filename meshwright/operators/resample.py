"""Daily resampling of keyed series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import missing_to_null


def daily(field: DataFrame, strict: bool = True, hours: int | None = None) -> DataFrame:
    """cell_id, day, x_min, x_max, x_mean of the days in field (cell_id, ts, x).

    Strict days are null if any value is missing, or, with hours, if the day does not have so many rows. One aggregate serves all three.
    """
    return field.groupBy("cell_id", F.col("ts").cast("date").alias("day")).agg(*extremes_and_mean(F.col("x"), strict, hours))


def extremes_and_mean(x: Column, strict: bool = True, hours: int | None = None) -> list[Column]:
    """x_min, x_max, x_mean of a group of hours."""
    x = missing_to_null(x)
    whole = F.count("*") == F.count(x)
    if hours is not None:
        whole = whole & (F.count("*") == hours)
    keep = (lambda c: F.when(whole, c)) if strict or hours is not None else (lambda c: c)
    return [keep(F.min(x)).alias("x_min"), keep(F.max(x)).alias("x_max"), keep(F.avg(x)).alias("x_mean")]


def calendar(field: DataFrame, ts: str = "ts") -> DataFrame:
    """day: every day from the first to the last of a field."""
    span = field.agg(F.min(F.col(ts).cast("date")).alias("a"), F.max(F.col(ts).cast("date")).alias("b"))
    return span.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
