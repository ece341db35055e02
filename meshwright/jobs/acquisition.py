"""Queries over tasks, requests, the ledger, and the files that tasks leave."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import ledger as L
from ..sources import files as X
from ..sources import tables as T
from ..streaming.logs import drained
from ..streaming.tail import numbered_lines, tail
from .catalog import LAG_DAYS, NOW, POINT_SQL, TILE_OF_SQL, TILE_SQL, YEARS_SQL, order_years, points
from .registry import query

HELD_SQL = f"SELECT t.* FROM ({TILE_SQL}) t WHERE grid_id IN (SELECT {TILE_OF_SQL} FROM ({POINT_SQL}))"
LABELS_SQL = "printf('%s%02d_%s%02d_%s%03d_%s%03d', if(north >= 0, 'N', 'S'), abs(north), if(south >= 0, 'N', 'S'), abs(south), if(west >= 0, 'E', 'W'), abs(west), if(east >= 0, 'E', 'W'), abs(east))"
FILE_SQL = f"printf('%04d/field_%d_%s_', year, year, grid_id) || {LABELS_SQL} || '.nc'"


def tile_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, last and the columns of each tile that holds a customer."""
    held = points(spark, sf_dir).select(G.tile_of(F.col("lat"), F.col("lon")).alias("grid_id")).distinct()
    tiles = T.small(G.tiles(spark).join(held, "grid_id", "left_semi"), 648)
    return order_years(spark, sf_dir).join(tiles, how="cross")


@query(f"""SELECT year || '_' || grid_id AS task_id, year, grid_id, "row", col, north, south, west, east, request_north, request_south, request_west, request_east, 'pending' AS status,
  0::INT AS attempts, NULL::VARCHAR AS start_time, NULL::VARCHAR AS end_time, NULL::DOUBLE AS duration_seconds, NULL::BIGINT AS file_size_bytes, make_date(year, 1, 1) AS coverage_start,
  NULL::DATE AS coverage_end, {FILE_SQL} AS output_file, NULL::VARCHAR AS last_error, NULL::VARCHAR AS updated_at FROM ({YEARS_SQL}) CROSS JOIN ({HELD_SQL})""", dates=("coverage_start", "coverage_end"))
def task_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new ledger of all years and tiles, written and read back."""
    ledger = T.write_table(L.new_ledger(tile_years(spark, sf_dir)), "ledger")
    return T.ensure_columns(ledger, *L.COLUMNS).withColumns({c: F.col(c).cast("string") for c in ("start_time", "end_time", "updated_at")})


@query(f"""WITH m AS (SELECT year, last, CAST(unnest(range(1, month(last) + 1)) AS INT) AS month FROM ({YEARS_SQL})),
d AS (SELECT year, month, CAST(CASE WHEN month = month(last) THEN day(last) ELSE day(last_day(make_date(year, month, 1))) END AS INT) AS last_day FROM m)
SELECT year || '_' || grid_id AS task_id, printf('month_%02d_days_01_%02d', month, last_day) AS chunk, 'field' AS variable, printf('%02d', month) AS month, last_day::BIGINT AS n_days, 24::BIGINT AS n_hours,
  'netcdf' AS data_format, request_north || ',' || request_west || ',' || request_south || ',' || request_east AS area FROM d CROSS JOIN ({HELD_SQL})""")
def tile_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to ask for: one request for each month of each task."""
    chunks = L.monthly_chunks(order_years(spark, sf_dir)).select("year", "month", "last_day", "chunk")
    tasks = tile_years(spark, sf_dir).drop("last").join(chunks, "year")
    asked = tasks.withColumn("request", L.request("field", F.col("year"), F.col("month"), F.col("last_day")))
    return asked.select(
        F.concat_ws("_", F.col("year").cast("string"), "grid_id").alias("task_id"),
        "chunk",
        F.element_at("request.variable", 1).alias("variable"),
        F.element_at("request.month", 1).alias("month"),
        F.size("request.day").cast("long").alias("n_days"),
        F.size("request.time").cast("long").alias("n_hours"),
        F.col("request.data_format").alias("data_format"),
        F.concat_ws(",", F.transform("request.area", lambda x: x.cast("string"))).alias("area"),
    )


@query(f"""WITH m AS (SELECT year, last, CAST(unnest(range(1, month(last) + 1)) AS INT) AS month FROM ({YEARS_SQL})),
d AS (SELECT year, month, CAST(CASE WHEN month = month(last) THEN day(last) ELSE day(last_day(make_date(year, month, 1))) END AS INT) AS last_day FROM m),
p AS (SELECT year(l_shipdate) AS year, month(l_shipdate) AS month FROM lineitem WHERE (year(l_shipdate) + month(l_shipdate)) % 7 <> 0 GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT day(l_shipdate)) >= 15)
SELECT year, month, printf('month_%02d_days_01_%02d', month, last_day) AS chunk FROM d WHERE (year, month) NOT IN (SELECT (year, month) FROM p)""")
def pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months still to be fetched; a month's part is there once its lines cover 15 days. Every seventh month's part was lost."""
    lines = T.read_table(spark, sf_dir, "lineitem").where((F.year("l_shipdate") + F.month("l_shipdate")) % 7 != 0)
    parts = lines.groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.countDistinct(F.dayofmonth("l_shipdate")).alias("n"))
    planned = L.monthly_chunks(order_years(spark, sf_dir)).select("year", "month", "chunk")
    return L.pending_chunks(planned, parts, ["year", "month"], 15)


#: Orders as tasks in years about NOW. Files of one in three are there; lines are attempts, those with a tax of 8 % fail.
TASK_SQL = "SELECT o_orderkey AS task_id, CAST(1999 + o_orderkey % 4 AS INT) AS year FROM orders"
SEEN_SQL = "make_date(year, 12, 31) - CAST(k % 5 AS INT)"


@query(f"""WITH t AS (SELECT *, CASE WHEN year < 2001 THEN make_date(year, 12, 31) WHEN year = 2001 THEN DATE '2001-11-15' END AS last FROM ({TASK_SQL})),
h AS (SELECT *, (last - make_date(year, 1, 1) + 1) * 24 AS hours FROM t),
f AS (SELECT task_id, hours - (task_id % 2) AS have, make_date(year, 12, 31) - CAST(task_id % 5 AS INT) AS seen FROM h WHERE task_id % 3 = 0 AND last IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_extendedprice) AS attempt FROM lineitem),
a AS (SELECT l_orderkey AS task_id, attempt, year, CASE WHEN l_tax > 0.075 THEN 'refused ' || attempt END AS error, hours - CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS n, hours,
  make_date(year, 12, 31) - CAST(l_partkey % 5 AS INT) AS seen FROM l JOIN h ON l_orderkey = task_id WHERE attempt <= 3),
w AS (SELECT task_id, min(attempt) FILTER (WHERE error IS NULL AND n >= hours) AS won, arg_min(seen, attempt) FILTER (WHERE error IS NULL AND n >= hours) AS reached, max(attempt) AS tried, arg_max(coalesce(error, 'too few hours'), attempt) AS error FROM a GROUP BY 1),
j AS (SELECT h.task_id, year, last, coalesce(have >= hours, false) AND (year < 2001 OR seen >= make_date(year, 12, 31)) AS done, won, reached, tried, error FROM h LEFT JOIN f USING (task_id) LEFT JOIN w USING (task_id)),
s AS (SELECT *, CASE WHEN last IS NULL THEN 'pending' WHEN done THEN 'completed' WHEN won IS NOT NULL THEN CASE WHEN year < 2001 OR reached >= make_date(year, 12, 31) THEN 'completed' ELSE 'partial' END WHEN tried IS NOT NULL THEN 'failed' ELSE 'doing' END AS status FROM j)
SELECT task_id, CASE WHEN last IS NULL THEN 'future' WHEN done THEN 'already_complete' ELSE status END AS outcome, status, CASE WHEN last IS NULL OR done THEN 0 ELSE coalesce(won, tried, 0) END::INT AS attempts,
  CASE WHEN last IS NOT NULL AND NOT done AND won IS NULL THEN error END AS last_error FROM s""")
def task_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = T.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), (1999 + F.col("o_orderkey") % 4).cast("int").alias("year"))
    last = L.last_available(F.col("year"), NOW, LAG_DAYS)
    due = tasks.withColumn("hours", L.expected_hours(F.col("year"), last)).where("hours IS NOT NULL")
    reached = lambda k: F.date_sub(F.make_date("year", F.lit(12), F.lit(31)), (F.col(k) % 5).cast("int"))
    files = due.where("task_id % 3 = 0").select("task_id", (F.col("hours") - F.col("task_id") % 2).alias("n"), reached("task_id").alias("last_seen"))
    numbered = X.numbered(T.read_table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice"], "attempt")
    lines = numbered.withColumnRenamed("l_orderkey", "task_id").join(due, "task_id")
    error = F.when(F.col("l_tax") > 0.075, F.concat(F.lit("refused "), F.col("attempt").cast("string")))
    hours = F.col("hours") - F.when(F.col("l_discount") > 0.05, 1).otherwise(0)
    tries = lines.select("task_id", "attempt", hours.alias("n"), reached("l_partkey").alias("last_seen"), error.alias("error"))
    return L.transitions(tasks, files, tries, NOW, LAG_DAYS)


@query("""SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n_times, strftime(arg_min(o_orderdate, o_orderkey), '%Y-%m-%d') AS first_ts, strftime(arg_max(o_orderdate, o_orderkey), '%Y-%m-%d') AS last_ts, true AS usable
FROM orders GROUP BY 1""")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as one file a year, discovered and looked into: how many times each has, the first and the last by place."""
    folder = T.shared_path(spark, "yearly-files")
    orders = T.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("year"))
    orders.repartition("year").sortWithinPartitions("year", "o_orderkey").write.partitionBy("year").parquet(folder)
    found = X.discover(spark, folder, "*.parquet")
    told = X.inventory(spark.read.parquet(folder), "o_orderdate")
    name = lambda c: F.regexp_extract(c, r"year=(\d+)/[^/]+$", 1).cast("int")
    plain = F.regexp_replace("path", "^file:/+", "/")  # the two readers write the scheme in two ways
    both = told.drop("length").withColumn("path", plain).join(found.withColumn("path", plain), "path", "left")
    listed = both.withColumn("usable", X.is_usable(L.LEAST_BYTES))
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return listed.select(name(F.col("path")).alias("year"), "n_times", text("first_ts"), text("last_ts"), "usable")


@query("""SELECT 'run-' || (user_id % 4) AS log, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS n, event_type || ': ' || event_id AS line FROM events
WHERE event_id > CASE user_id % 4 WHEN 1 THEN (SELECT max(event_id) // 2 FROM events) ELSE -1 END""")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of four growing logs since the last look: half of number 1 was read before; number 2 has been cut since, so it is read from its start."""
    folder = T.shared_path(spark, "run-logs")
    events = T.read_table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("log"), "event_id", F.concat("event_type", F.lit(": "), F.col("event_id").cast("string")).alias("line"))
    events.repartition("log").sortWithinPartitions("log", "event_id").select("log", "line").write.partitionBy("log").text(folder)
    half = F.broadcast(events.agg(F.floor(F.max("event_id") / 2).alias("half")))
    (read,) = events.where("log = 1").join(half, F.col("event_id") <= F.col("half")).agg(F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0))).first()
    # one path for each log
    paths = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").collect()]
    before = {p: read if "/log=1/" in p else 1 << 40 for p in paths if re.search("/log=[12]/", p)}
    lines = numbered_lines(drained(tail(spark, folder, r".*\.txt", offsets=before)))
    return lines.select(F.concat(F.lit("run-"), F.regexp_extract("path", "/log=([^/]+)/", 1)).alias("log"), "n", "line")


@query("""WITH f AS (SELECT CAST(year(l_shipdate) AS INT) AS year, count(*) AS n_times, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_days FROM lineitem GROUP BY 1)
SELECT year, n_times, n_days FROM f WHERE n_days = dayofyear(make_date(year, 12, 31)) ORDER BY year LIMIT 1""")
def first_whole_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lines' years, as files, the first that has all its days: the one that a run takes as its reference."""
    lines = T.read_table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_shipdate").cast("date").alias("day"))
    files = lines.groupBy("year", "day").agg(F.count("*").alias("n")).groupBy("year").agg(F.sum("n").alias("n_times"), F.count("day").alias("n_days"))
    whole = files.withColumn("whole", F.col("n_days") == F.dayofyear(F.make_date("year", F.lit(12), F.lit(31))))
    return X.first_valid(whole, "whole", "year").drop("whole")


@query("""WITH a AS (SELECT l_orderkey AS task_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_extendedprice) AS attempt, l_tax <= 0.01 AS ok FROM lineitem),
w AS (SELECT task_id, min(attempt) FILTER (WHERE ok AND attempt <= 5) AS won, least(max(attempt), 5) AS tried FROM a GROUP BY 1),
m AS (SELECT task_id, coalesce(won, tried) AS attempts, CASE WHEN won IS NOT NULL THEN 'completed' WHEN tried = 5 THEN 'failed' ELSE 'waiting' END AS outcome FROM w),
n AS (SELECT *, attempts - CASE outcome WHEN 'waiting' THEN 0 ELSE 1 END AS waits FROM m)
SELECT task_id, CAST(attempts AS INT) AS attempts, outcome, CAST(waits AS INT) AS waits, CAST(coalesce(list_sum(list_transform(range(waits), lambda k: least(60, 5 * 2 ** k))), 0) AS BIGINT) AS waited_seconds FROM n""")
def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks, lines as their attempts: how often each is tried and how long it waits in between."""
    tries = X.numbered(T.read_table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice"], "attempt")
    return L.retry_plan(tries.select(F.col("l_orderkey").alias("task_id"), "attempt", (F.col("l_tax") <= 0.01).alias("ok")), "task_id", most=5)
