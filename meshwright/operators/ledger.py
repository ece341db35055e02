"""Planning of acquisition tasks and the ledger of their states."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import shortened
from .running import running_total

STATES = ("pending", "doing", "completed", "partial", "failed")
FIRST_YEAR = 1950
LEAST_BYTES = 1024
#: The ledger's columns in their order.
COLUMNS = {
    "task_id": "string", "year": "int", "grid_id": "string", "row": "int", "col": "int",
    "north": "int", "south": "int", "west": "int", "east": "int",
    "request_north": "double", "request_south": "double", "request_west": "double", "request_east": "double",
    "status": "string", "attempts": "int", "start_time": "timestamp", "end_time": "timestamp", "duration_seconds": "double",
    "file_size_bytes": "bigint", "coverage_start": "date", "coverage_end": "date", "output_file": "string",
    "last_error": "string", "updated_at": "timestamp",
}


def last_available(year: Column, now: dt.date, lag_days: int) -> Column:
    """The last day of a year that can be had, null for a year to come."""
    cutoff = now - dt.timedelta(days=lag_days)
    return F.when(year < cutoff.year, F.make_date(year, F.lit(12), F.lit(31))).when(year == cutoff.year, F.lit(cutoff))


def expected_hours(year: Column, last: Column) -> Column:
    """Hours from the year's start to the end of the last day; the first year of all lacks its first hour."""
    return (F.datediff(last, F.make_date(year, F.lit(1), F.lit(1))) + 1) * 24 - F.when(year == FIRST_YEAR, 1).otherwise(0)


def monthly_chunks(years: DataFrame) -> DataFrame:
    """year, month, last_day, chunk, days, times of each month up to last (a date)."""
    months = years.withColumn("month", F.explode(F.sequence(F.lit(1), F.month("last"))))
    end = F.when(F.col("month") == F.month("last"), F.dayofmonth("last")).otherwise(F.dayofmonth(F.last_day(F.make_date("year", "month", F.lit(1)))))
    chunked = months.withColumn("last_day", end)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return chunked.select(
        "year",
        "month",
        "last_day",
        F.concat(F.lit("month_"), two(F.col("month")), F.lit("_days_01_"), two(F.col("last_day"))).alias("chunk"),
        F.concat_ws(",", F.transform(F.sequence(F.lit(1), "last_day"), lambda d: two(d))).alias("days"),
        F.concat_ws(",", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.concat(two(h), F.lit(":00")))).alias("times"),
    )


def coordinate_label(value: Column, positive: str, negative: str, width: int) -> Column:
    return F.concat(F.when(value >= 0, positive).otherwise(negative), F.format_string(f"%0{width}d", F.abs(value)))


def tile_filename(year: Column, prefix: str = "field") -> Column:
    """The name of a year's file of a tile (grid_id, north, south, west, east): prefix, year, tile and its four sides."""
    sides = [coordinate_label(F.col(c), *signs) for c, signs in (("north", ("N", "S", 2)), ("south", ("N", "S", 2)), ("west", ("E", "W", 3)), ("east", ("E", "W", 3)))]
    return F.concat(F.concat_ws("_", F.lit(prefix), year.cast("string"), "grid_id", *sides), F.lit(".nc"))


def request(variable: str, year: Column, month: Column, last_day: Column) -> Column:
    """What to ask for a month of a tile: text fields, lists of days and hours, and the area as north, west, south, east."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.struct(
        F.array(F.lit(variable)).alias("variable"),
        year.cast("string").alias("year"),
        F.array(two(month)).alias("month"),
        F.transform(F.sequence(F.lit(1), last_day), two).alias("day"),
        F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.concat(two(h), F.lit(":00"))).alias("time"),
        F.lit("netcdf").alias("data_format"),
        F.lit("unarchived").alias("download_format"),
        F.array("request_north", "request_west", "request_south", "request_east").alias("area"),
    )


def new_ledger(tasks: DataFrame, prefix: str = "field") -> DataFrame:
    """The ledger's 24 columns for tasks (year and the columns of a tile), all pending."""
    stated = {
        "task_id": F.concat_ws("_", F.col("year").cast("string"), "grid_id"),
        "status": F.lit("pending"),
        "attempts": F.lit(0),
        "coverage_start": F.make_date("year", F.lit(1), F.lit(1)),
        "output_file": F.concat(F.format_string("%04d/", "year"), tile_filename(F.col("year"), prefix)),
    }
    return tasks.select(*[stated.get(c, F.col(c) if c in tasks.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def pending_chunks(planned: DataFrame, parts: DataFrame, keys: list[str], least_rows: int = 1) -> DataFrame:
    """The planned chunks without a part that is there and whole: what a run that goes on has to fetch again. parts has keys, n."""
    return planned.join(parts.where(F.col("n") >= least_rows).select(*keys), keys, "left_anti")


def transitions(tasks: DataFrame, files: DataFrame, tries: DataFrame, now: dt.date, lag_days: int, most_tries: int = 3) -> DataFrame:
    """One run over tasks (task_id, year): task_id, outcome, status, attempts, last_error.

    files has task_id, n (rows), last_seen of what is there before the run; tries has task_id, attempt (from 1), n, last_seen, error, what
    each attempt would give. A year to come is left alone (outcome future). A file with the hours that the year must have by now
    ends a task as already_complete, if its year is over or it reaches the year's end; else the task is tried: the first attempt without an
    error and with the hours ends it as completed or partial; after most_tries it has failed, with the last error.
    """
    last = last_available(F.col("year"), now, lag_days)
    due = tasks.withColumn("last", last).withColumn("hours", expected_hours(F.col("year"), F.col("last")))
    there = due.join(files.select("task_id", F.col("n").alias("have"), F.col("last_seen").alias("seen")), "task_id", "left")
    known = status_for_year(F.col("year"), F.col("seen"), now.year)
    done = F.coalesce(F.col("have") >= F.col("hours"), F.lit(False)) & (known == "completed")
    numbered = tries.where(F.col("attempt") <= most_tries).join(due.select("task_id", "hours", "year"), "task_id")
    good = F.col("error").isNull() & (F.col("n") >= F.col("hours"))
    told = numbered.groupBy("task_id").agg(
        F.min(F.when(good, F.col("attempt"))).alias("won"),
        F.min_by(F.when(good, F.col("last_seen")), F.when(good, F.col("attempt"))).alias("reached"),
        F.max("attempt").alias("tried"),
        F.max_by(F.coalesce("error", F.lit("too few hours")), "attempt").alias("error"),
    )
    faced = there.join(told, "task_id", "left")
    won = status_for_year(F.col("year"), F.col("reached"), now.year)
    future, tried = F.col("last").isNull(), F.col("tried").isNotNull()
    status = F.when(future, "pending").when(done, "completed").when(F.col("won").isNotNull(), won).when(tried, "failed").otherwise("doing")
    return faced.select(
        "task_id",
        F.when(future, "future").when(done, "already_complete").otherwise(status).alias("outcome"),
        status.alias("status"),
        F.when(future | done, 0).otherwise(F.coalesce("won", "tried", F.lit(0))).cast("int").alias("attempts"),
        F.when(~future & ~done & F.col("won").isNull() & tried, shortened(F.col("error"))).alias("last_error"),
    )


def durations(ledger: DataFrame, key: str, seconds: str) -> DataFrame:
    """key, n, hours, mean_minutes of a column of seconds in any form; what isn't a number counts for nothing, a key without numbers has 0."""
    number = F.col(seconds).try_cast("double")
    total = F.coalesce(F.sum(number) / 3600, F.lit(0.0))
    return ledger.groupBy(key).agg(F.count("*").alias("n"), F.round(total, 3).alias("hours"), F.round(F.coalesce(F.avg(number) / 60, F.lit(0.0)), 3).alias("mean_minutes"))


def status_for_year(year: Column, last_seen: Column, now_year: int) -> Column:
    """completed for past years and for years seen to their end, else partial."""
    return F.when(year < now_year, "completed").when(last_seen >= F.make_date(year, F.lit(12), F.lit(31)), "completed").otherwise("partial")


def latest(updates: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """An append-only log to its state: the last value of each field by key, and how many updates there were."""
    at = F.struct(*order)
    return updates.groupBy(key).agg(*[F.max_by(f, at).alias(f) for f in fields], F.count("*").alias("attempts"))


def status_counts(ledger: DataFrame, status: str, states: list[str]) -> DataFrame:
    """status, n for every state, those without rows too."""
    every = ledger.sparkSession.createDataFrame([(s,) for s in states], "status string")
    found = ledger.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return F.broadcast(every).join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def reconcile(tasks: DataFrame, files: DataFrame, key: str, now_year: int, least_rows: int = 1) -> DataFrame:
    """tasks (key, year, status) against the files that are there (key, n, last_seen): key, year, status, error.

    A file that is there and whole sets the state by its year; one that is not whole, or missing though the state says otherwise, sends the
    task back to pending with an error; all else stays.
    """
    joined = tasks.join(files, key, "left")
    there = F.col("n").isNotNull() & (F.col("year") <= now_year)
    whole = F.col("n") >= least_rows
    stale = F.col("status").isin("doing", "completed", "partial")
    status = F.when(there & whole, status_for_year(F.col("year"), F.col("last_seen"), now_year)).when(there | stale, "pending").otherwise(F.col("status"))
    error = F.when(there & ~whole, "file is not whole").when(~there & stale, "file is missing")
    return joined.select(key, "year", status.alias("status"), error.alias("error"))


def candidates(ledger: DataFrame, key: str, cutoff_year: int, limit: int | None = None) -> DataFrame:
    """Tasks to run next, in order of year and key."""
    open_tasks = ledger.where(F.col("status").isin("pending", "failed", "partial") & (F.col("year") <= cutoff_year)).select(key, "year", "status")
    return open_tasks.orderBy("year", key).limit(limit) if limit else open_tasks


def backoff_seconds(attempt: Column) -> Column:
    """Wait after an attempt (from 0)."""
    return F.least(F.lit(60.0), 5 * F.pow(F.lit(2.0), attempt)).cast("long")


def retry_plan(tries: DataFrame, key: str, most: int) -> DataFrame:
    """key, attempts, outcome, waits, waited_seconds from the tries (key, attempt from 1, ok) of each task. A task is tried until it succeeds, at most so many times; it waits
    after each failed attempt, but not after its last. Without a success, and with attempts left, it is waiting."""
    won = F.min(F.when(F.col("ok") & (F.col("attempt") <= most), F.col("attempt")))
    told = tries.groupBy(key).agg(won.alias("won"), F.least(F.max("attempt"), F.lit(most)).alias("tried"))
    outcome = F.when(F.col("won").isNotNull(), "completed").when(F.col("tried") == most, "failed").otherwise("waiting")
    made = told.select(key, F.coalesce("won", "tried").cast("int").alias("attempts"), outcome.alias("outcome"))
    waits = F.col("attempts") - (F.col("outcome") != "waiting").cast("int")
    seconds = F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), F.lit(0).cast("long"), lambda s, k: s + F.when(k < F.col("waits"), backoff_seconds(k)).otherwise(0))
    return made.withColumn("waits", waits).withColumn("waited_seconds", seconds)


def keep_first(parts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order: an aggregate, so nothing is sorted."""
    others = [c for c in parts.columns if c not in keys]
    kept = parts.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_first"))
    return kept.select(*keys, *[F.col("_first")[c].alias(c) for c in others])


def offsets(lengths: DataFrame, order: str, n: str) -> DataFrame:
    """Exclusive running sums of groups, as a compressed sparse row index needs them, without one task for all groups."""
    return running_total(lengths, [order], F.col(n), "offset")


def grid_members(tasks: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """tasks with `wanted`: whether their key is one of those wanted."""
    named = wanted.select(key).distinct().withColumn("wanted", F.lit(True))
    return tasks.join(named, key, "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
