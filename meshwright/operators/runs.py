"""Runs over years that do not stop for a bad year, and what is told about them."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import shortened
from ..sources.files import in_year
from ..sources.tables import write_table
from . import frames
from .quality import check_run

LOG = "year int, rows bigint, error string"
#: What a year's data can do: checks that fail, and jobs that end with an error of their own. Errors of the program itself are raised.
FAULTS = (ValueError, ArithmeticError, SparkRuntimeException, PythonException, Py4JJavaError)


def years_one_by_one(spark: SparkSession, start_year: int, end_year: int, work: Callable[[int], DataFrame]) -> tuple[list[DataFrame], DataFrame]:
    """Run work for each year as a job of its own. Gives the written results of the years that ended well, and the log: year, rows, error. A year that
    fails leaves nothing behind but its line; years are few, so the driver goes through them."""
    check_run(start_year, end_year)
    done, log = [], []
    for year in range(start_year, end_year + 1):
        try:
            made = write_table(work(year), f"year-{year}")
            done.append(made)
            log.append((year, made.count(), None))
        except FAULTS as error:
            log.append((year, 0, str(error).strip().split("\n")[0] or type(error).__name__))
    return done, spark.createDataFrame(log, LOG).withColumn("error", shortened(F.col("error")))


def whole_year(df: DataFrame, ts: str, year: int) -> DataFrame:
    """The rows of a year, if it has any and a day for each of the calendar's; else an error."""
    rows = in_year(df, ts, year)
    days = rows.agg(F.countDistinct(F.col(ts).cast("date"))).first()[0]
    due = 366 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 365
    if days != due:
        raise ValueError(f"{days} days of {due}")
    return rows


def exact_year(field: DataFrame, year: int, ts: str = "ts") -> DataFrame:
    """The rows of a year, if their hours are exactly those of its calendar; else an error that says what is wrong."""
    rows = in_year(field, ts, year)
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz")
    found = rows.groupBy(hour.alias("hour")).agg(F.max(F.col(ts) != hour).alias("odd")).agg(F.count("*"), F.count_if("odd")).first()
    due = 24 * (366 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 365)
    if found[1]:
        raise ValueError(f"{found[1]} times between hours")
    if found[0] != due:
        raise ValueError(f"{found[0]} hours of {due}")
    return rows


def city_years(field: DataFrame, weights: DataFrame, cities: DataFrame, start_year: int, end_year: int) -> tuple[DataFrame | None, DataFrame]:
    """The whole run over field (cell_id, ts, x): for each year the exact calendar of hours, strict days of 24 hours, weighted city-day statistics, all written; and the
    log with the reason of each year that failed. Gives the statistics of the years that ended well (None if none did) and the log."""
    done, log = years_one_by_one(field.sparkSession, start_year, end_year, lambda year: frames.city_daily(exact_year(field, year), weights, cities, hours=24, places=6))
    out = None
    for made in done:
        out = made if out is None else out.unionByName(made)
    return out, log


def run_summary(log: DataFrame) -> DataFrame:
    """n_years, n_completed, n_failed, total_rows."""
    failed = F.col("error").isNotNull()
    return log.agg(F.count("*").alias("n_years"), F.count_if(~failed).alias("n_completed"), F.count_if(failed).alias("n_failed"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"))


def run_document(log: DataFrame, files: DataFrame, **stated: object) -> DataFrame:
    """One row: a JSON document of what was asked for, the years that ended well or failed, the files of each year (year, n_files) and the rows in all.
    Lists have an entry per year."""
    failed = F.col("error").isNotNull()
    years = log.agg(
        F.array_sort(F.collect_list(F.when(~failed, F.col("year")))).alias("completed_years"),
        F.array_sort(F.collect_list(F.when(failed, F.struct("year", "error")))).alias("failed_years"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
    )
    sources = files.agg(F.array_sort(F.collect_list(F.struct("year", "n_files"))).alias("source_files_by_year"))
    both = years.crossJoin(F.broadcast(sources))
    told = [F.lit(v).alias(k) for k, v in stated.items()]
    return both.select(F.to_json(F.struct(*told, "completed_years", "failed_years", "source_files_by_year", "total_rows")).alias("report"))


def literal(value: object) -> Column:
    """A constant of any depth: dicts become structs, lists arrays."""
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    return F.array(*map(literal, value)) if isinstance(value, list | tuple) else F.lit(value)


def run_metadata(log: DataFrame, files: DataFrame, told: DataFrame, stated: dict) -> DataFrame:
    """One row: a JSON document of how a run was done and what came of it. stated is what the run was asked for and by which methods; to it come the counts of regions by status
    (told: city_id, status), the years that ended well or failed, the files of each year (year, n_files) and in all, and the rows. Lists have an entry per year."""
    failed = F.col("error").isNotNull()
    years = log.agg(
        F.array_sort(F.collect_list(F.when(~failed, F.col("year")))).alias("completed_years"),
        F.array_sort(F.collect_list(F.when(failed, F.struct("year", "error")))).alias("failed_years"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
    )
    regions = told.agg(F.count("*").alias("region_count"), *[F.count_if(c).alias(n) for n, c in (("processed_region_count", F.col("status") != "skipped"), ("repaired_region_count", F.col("status") == "repaired"), ("skipped_region_count", F.col("status") == "skipped"))])
    sources = files.agg(F.coalesce(F.sum("n_files"), F.lit(0)).alias("number_of_input_files"), F.array_sort(F.collect_list(F.struct("year", "n_files"))).alias("source_files_by_year"))
    # three rows of one aggregate each
    one = years.crossJoin(F.broadcast(regions)).crossJoin(F.broadcast(sources))
    found = ["region_count", "processed_region_count", "repaired_region_count", "skipped_region_count", "number_of_input_files", "completed_years", "failed_years", "source_files_by_year", "total_rows"]
    return one.select(F.to_json(F.struct(*[literal(v).alias(k) for k, v in stated.items()], *found)).alias("report"))
