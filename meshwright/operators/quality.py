"""Checks of series and grids, as tables of what they find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import hours_in_year


def hour(c: F.Column) -> F.Column:
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def hourly_completeness(df: DataFrame, ts: str = "ts") -> DataFrame:
    """day, n_rows, n_hours, complete."""
    return df.groupBy(F.col(ts).cast("date").alias("day")).agg(F.count("*").alias("n_rows"), F.countDistinct(F.hour(ts)).alias("n_hours")).withColumn("complete", F.col("n_hours") == 24)


def missing_hours(df: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """key, hour of every hour between the first and the last that a key lacks. The calendar is 8,766 rows a year."""
    seen = df.select(F.col(key), hour(F.col(ts)).alias("hour")).distinct()
    span = df.agg(hour(F.min(ts)).alias("a"), hour(F.max(ts)).alias("b"))
    calendar = span.select(F.explode(F.expr("sequence(a, b, INTERVAL 1 HOUR)")).alias("hour"))
    return df.select(key).distinct().join(F.broadcast(calendar), how="cross").join(seen, [key, "hour"], "left_anti")


def exact_hours(df: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """key, year, n, expected, first_wrong, exact: whether a key's rows of a year are the hours of that year one by one, in order, from its first.
    first_wrong is the position (from 0) where they first leave the calendar: a gap, a repeat, or a time between hours; null if nowhere."""
    year = F.year(ts)
    position = F.row_number().over(Window.partitionBy(key, year).orderBy(ts)) - 1
    due = F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("position"))
    placed = df.select(key, ts).withColumns({"year": year, "position": position}).withColumn("wrong", F.col(ts) != due)
    found = placed.groupBy(key, "year").agg(F.count("*").alias("n"), F.min(F.when(F.col("wrong"), F.col("position"))).alias("first_wrong"))
    expected = hours_in_year(F.col("year")).cast("long")
    return found.withColumn("expected", expected).withColumn("exact", F.col("first_wrong").isNull() & (F.col("n") == F.col("expected")))


def year_days(df: DataFrame, ts: str) -> DataFrame:
    """year, n_days, expected_days, complete."""
    found = df.groupBy(F.year(ts).alias("year")).agg(F.countDistinct(F.col(ts).cast("date")).alias("n_days"))
    expected = (hours_in_year(F.col("year")) / 24).cast("long")
    return found.withColumn("expected_days", expected).withColumn("complete", F.col("n_days") == F.col("expected_days"))


def first_mismatch(df: DataFrame, ts: str) -> DataFrame:
    """year, position, expected, found where a year's days first leave the calendar, by position."""
    days = df.select(F.year(ts).alias("year"), F.col(ts).cast("date").alias("found")).distinct()
    ranked = days.withColumn("position", F.row_number().over(Window.partitionBy("year").orderBy("found")))
    placed = ranked.withColumn("expected", F.date_add(F.make_date("year", F.lit(1), F.lit(1)), F.col("position") - 1))
    wrong = placed.where(F.col("expected") != F.col("found"))
    return wrong.groupBy("year").agg(F.min("position").alias("position"), F.min_by("expected", "position").alias("expected"), F.min_by("found", "position").alias("found"))


def duplicates(df: DataFrame, key: str, first: int | None = None) -> DataFrame:
    """key, n of the keys with more than one row; the first few in order, if asked."""
    found = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return found.orderBy(key).limit(first) if first else found


def order_violations(df: DataFrame, group: str, position: str, ts: str) -> DataFrame:
    """Rows whose time is not after that of the row before, within a file (group)."""
    before = F.lag(ts).over(Window.partitionBy(group).orderBy(position))
    return df.withColumn("before", before).where(F.col(ts) <= F.col("before")).select(group, position, ts, "before")


def spacing(df: DataFrame, group: str, coordinate: str, step: float, within: float = 1e-6) -> DataFrame:
    """group, n, least, greatest, wrong: the steps between neighbours, and how many are not the wanted one."""
    by = Window.partitionBy(group).orderBy(coordinate)
    steps = df.select(group, coordinate).distinct().withColumn("step", F.abs(F.col(coordinate) - F.lag(coordinate).over(by)))
    return steps.groupBy(group).agg(F.count("*").alias("n"), F.min("step").alias("least"), F.max("step").alias("greatest"), F.count_if(F.abs(F.col("step") - step) > within).alias("wrong"))


def grids_that_differ(df: DataFrame, group: str, position: str, coordinate: str) -> DataFrame:
    """group, n, same_as_reference: each group's coordinates, place by place, against those of the first group. Places are joined, so a grid may
    have any size; a grid in another order, or with repeats, differs."""
    first = df.agg(F.min(group)).first()[0]
    reference = df.where(F.col(group) == F.lit(first)).select(F.col(position).alias("_p"), F.col(coordinate).alias("_c"))
    size = reference.count()
    faced = df.select(group, position, coordinate).join(reference, F.col(position) == F.col("_p"), "left")
    same = F.bool_and(F.coalesce(F.col(coordinate).eqNullSafe(F.col("_c")) & F.col("_p").isNotNull(), F.lit(False)))
    return faced.groupBy(group).agg(F.count("*").alias("n"), same.alias("_same")).select(group, "n", (F.col("_same") & (F.col("n") == size)).alias("same_as_reference"))


def reference_grid(df: DataFrame, group: str, coordinate: str, step: float) -> DataFrame:
    """The coordinates of the first group whose grid is whole: two points or more, all steps the wanted one. Groups before it are left out."""
    good = spacing(df, group, coordinate, step).where("n > 1 AND wrong = 0").agg(F.min(group).alias(group))
    return df.join(F.broadcast(good), group, "left_semi").select(group, coordinate).distinct()


def missing_members(df: DataFrame, column: str, required: list) -> DataFrame:
    """column: the required values that no row has."""
    wanted = df.sparkSession.createDataFrame([(x,) for x in required], df.select(column).schema)
    return wanted.join(df.select(column), column, "left_anti")


def series_faults(df: DataFrame, group: str, position: str, ts: str) -> DataFrame:
    """group, n, n_missing, n_repeated, n_disordered: what keeps a file's times from being there, unique and increasing."""
    before = F.lag(ts).over(Window.partitionBy(group).orderBy(position))
    marked = df.withColumn("_before", before)
    return marked.groupBy(group).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(ts).isNull()).alias("n_missing"),
        (F.count(ts) - F.countDistinct(ts)).alias("n_repeated"),
        F.count_if(F.col(ts) < F.col("_before")).alias("n_disordered"),
    )


def check_run(start_year: int, end_year: int, chunk_hours: int = 1, workers: int = 1) -> None:
    """Arguments of a run, or an error that says what is wrong."""
    if start_year > end_year:
        raise ValueError(f"the start year {start_year} is after the end year {end_year}")
    if chunk_hours <= 0 or workers < 1:
        raise ValueError("chunks must be longer than 0 hours and workers at least 1")
