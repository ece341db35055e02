"""Queries over runs of years, series and what is told about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cube as C
from ..operators import polygons as P
from ..operators import quality as Q
from ..operators import runs as R
from ..operators import series
from ..sources import files as X
from ..sources import tables as T
from .regions import regions
from .registry import query

START, END = 1995, 2002
DAYS_SQL = """SELECT y.year, count(DISTINCT CAST(l_shipdate AS DATE)) AS days, CAST(dayofyear(make_date(y.year, 12, 31)) AS BIGINT) AS due, count(l_shipdate) AS n
FROM (SELECT CAST(unnest(range(1995, 2003)) AS INT) AS year) y LEFT JOIN lineitem ON year(l_shipdate) = y.year GROUP BY 1"""
LOG_SQL = f"SELECT year, CASE WHEN days = due THEN n ELSE 0 END AS rows, CASE WHEN days <> due THEN days || ' days of ' || due END AS error FROM ({DAYS_SQL})"


def year_runs(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame]:
    lines = T.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    return R.years_one_by_one(spark, START, END, lambda year: R.whole_year(lines, "l_shipdate", year))


@query(LOG_SQL)
def year_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years whose days are whole are worked on; the others are told with what they lack."""
    return year_runs(spark, sf_dir)[1]


@query(f"SELECT count(*) AS n_years, count(*) FILTER (WHERE error IS NULL) AS n_completed, count(*) FILTER (WHERE error IS NOT NULL) AS n_failed, CAST(sum(rows) AS BIGINT) AS total_rows FROM ({LOG_SQL})")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_summary(year_runs(spark, sf_dir)[1])


@query(f"""WITH l AS ({LOG_SQL}), f AS (SELECT CAST(year(l_shipdate) AS INT) AS year, count(DISTINCT l_suppkey) AS n_files FROM lineitem GROUP BY 1)
SELECT to_json({{'start_year': {START}, 'end_year': {END}, 'input_frequency': 'hourly', 'output_frequency': 'daily',
  'completed_years': (SELECT coalesce(list(year ORDER BY year) FILTER (WHERE error IS NULL), []) FROM l),
  'failed_years': (SELECT coalesce(list({{'year': year, 'error': error}} ORDER BY year) FILTER (WHERE error IS NOT NULL), []) FROM l),
  'source_files_by_year': (SELECT list({{'year': year, 'n_files': n_files}} ORDER BY year) FROM f), 'total_rows': (SELECT CAST(sum(rows) AS BIGINT) FROM l)}})::VARCHAR AS report""")
def run_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.read_table(spark, sf_dir, "lineitem")
    files = lines.groupBy(F.year("l_shipdate").alias("year")).agg(F.countDistinct("l_suppkey").alias("n_files"))
    return R.run_document(year_runs(spark, sf_dir)[1], files, start_year=START, end_year=END, input_frequency="hourly", output_frequency="daily")


CITY_RUN_SQL = """WITH cells AS (SELECT l_suppkey % 5 AS cell, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
hours AS (SELECT cell, day, h FROM cells, range(24) t(h) WHERE NOT (q % 10 = 0 AND h = 7) AND NOT (day = DATE '1997-03-03' AND h = 5)),
y AS (SELECT CAST(unnest(range(1995, 2003)) AS INT) AS year), have AS (SELECT CAST(year(day) AS INT) AS year, count(DISTINCT (day, h)) AS n FROM hours GROUP BY 1),
whole AS (SELECT y.year, coalesce(n, 0) AS n, CAST(dayofyear(make_date(y.year, 12, 31)) AS BIGINT) AS days FROM y LEFT JOIN have USING (year)),
w AS (SELECT s_nationkey % 3 AS city, s_suppkey % 5 AS cell FROM supplier GROUP BY 1, 2 HAVING sum(s_acctbal) > 0),
valid AS (SELECT DISTINCT CAST(year(day) AS INT) AS year, day, city FROM (SELECT cell, day FROM hours GROUP BY 1, 2 HAVING count(*) = 24) JOIN w USING (cell)),
cities AS (SELECT count(DISTINCT s_nationkey % 3) AS n FROM supplier)
SELECT year, CASE WHEN whole.n = days * 24 THEN days * cities.n ELSE 0 END AS rows, CASE WHEN whole.n <> days * 24 THEN whole.n || ' hours of ' || days * 24 END AS error,
  CASE WHEN whole.n = days * 24 THEN (SELECT count(*) FROM valid v WHERE v.year = whole.year) ELSE 0 END AS n_valid FROM whole, cities"""


@query(CITY_RUN_SQL)
def city_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of hourly values in one call: calendar, strict days, weights, log. Some days of a cell lack an hour, 1997 lacks one of all cells."""
    sums = T.read_table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("cell_id"), F.col("l_shipdate").cast("date").alias("day")).agg(F.sum("l_quantity").alias("q"))
    sums = T.write_table(sums, "cell-days").withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    kept = sums.where(~((F.col("q") % 10 == 0) & (F.col("h") == 7)) & ~((F.col("day") == F.lit("1997-03-03").cast("date")) & (F.col("h") == 5)))
    field = kept.select("cell_id", (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("h"))).alias("ts"), (F.col("q") + F.col("h")).cast("double").alias("x"))
    supplier = T.read_table(spark, sf_dir, "supplier")
    weights = supplier.groupBy((F.col("s_nationkey") % 3).alias("city_id"), (F.col("s_suppkey") % 5).alias("cell_id")).agg(F.sum("s_acctbal").alias("area"))
    cities = weights.groupBy("city_id").agg((F.sum(F.abs("area")) + 1).alias("city_area")).withColumn("city_name", F.concat(F.lit("c"), F.col("city_id").cast("string")))
    made, log = R.city_years(field, weights, cities, START, END)
    if made is None:
        return log.withColumn("n_valid", F.lit(0).cast("long"))
    valid = made.groupBy(F.year("date_utc").alias("year")).agg(F.count("x_mean_mean").alias("n_valid"))
    return log.join(valid, "year", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))


BLOCK_SQL = """SELECT DISTINCT CAST(user_id % 6 AS INT) AS tile, CAST(ts AS DATE) AS low, CAST(ts AS DATE) + CASE WHEN user_id % 6 = 1 AND day(ts) % 7 = 0 THEN 2 ELSE 1 END AS high
FROM events WHERE NOT (user_id % 6 = 2 AND day(ts) % 10 = 0)"""


@query(f"""WITH b AS ({BLOCK_SQL}), hull AS (SELECT min(low) AS a, max(high) AS z FROM b), e AS (SELECT tile, low AS t, 1 AS c FROM b UNION ALL SELECT tile, high, -1 FROM b
  UNION ALL SELECT CAST(range AS INT), a, 0 FROM hull, range(7) UNION ALL SELECT CAST(range AS INT), z, 0 FROM hull, range(7)),
s AS (SELECT tile, t, sum(c) AS c FROM e GROUP BY 1, 2),
r AS (SELECT tile, t AS low, lead(t) OVER w AS high, CAST(sum(c) OVER w AS BIGINT) AS n FROM s WINDOW w AS (PARTITION BY tile ORDER BY t))
SELECT tile, strftime(low, '%Y-%m-%d') AS low, strftime(high, '%Y-%m-%d') AS high, n FROM r WHERE high IS NOT NULL AND n <> 1""")
def cube_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a tile and a day: tile 1 overlaps every seventh day, tile 2 has holes, tile 6 is not there."""
    day, tile = F.col("ts").cast("date"), (F.col("user_id") % 6).cast("int")
    long = F.when((tile == 1) & (F.dayofmonth("ts") % 7 == 0), 2).otherwise(1)
    events = T.read_table(spark, sf_dir, "events").where(~((tile == 2) & (F.dayofmonth("ts") % 10 == 0)))
    blocks = events.select(tile.alias("tile"), day.alias("low"), F.date_add(day, long).alias("high")).distinct()
    found = C.cover_faults(blocks, tiles=spark.range(7).select(F.col("id").cast("int").alias("tile")))
    return found.select("tile", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"), "n")


#: How a run of years is done, as its document states it.
METHOD = {
    "dataset": "lines by supplier", "variable": "x", "long_name": "hourly value of a cell", "requested_start_year": START, "requested_end_year": END,
    "input_frequency": "hourly", "output_frequency": "daily", "timezone": "UTC", "input_units": "as given", "output_units": "as given",
    "temporal_processing": {"x_min": "least of 24 hours", "x_max": "greatest of 24 hours", "x_mean": "mean of 24 hours"},
    "time_validation": "the hours of a year are those of its calendar, 8760 or 8784",
    "daily_missing_policy": "a day of a cell that lacks an hour is missing",
    "boundary": "polygons about the customers of a nation", "country": "home",
    "geometry_handling": "edges that cross are cut and what an odd number of rings surrounds is kept; regions without an area are skipped and counted",
    "spatial_grid": "regular, a quarter of a degree", "spatial_weight": "area of the overlap of cell and region",
    "area_method": "authalic heights on the ellipsoid", "statistics": ["mean", "max", "min", "p25", "p75", "valid_area_fraction"],
    "quantile_method": "least value at which the running weight reaches the share", "grid_coverage_fraction": "area in cells over the area of the region",
    "chunk_hours": 24, "input_directory": "lineitem", "combined_output": "year by year",
}


def as_sql(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ", ".join(f"'{k}': {as_sql(v)}" for k, v in value.items()) + "}"
    return "[" + ", ".join(map(as_sql, value)) + "]" if isinstance(value, list) else f"'{value}'" if isinstance(value, str) else str(value)


@query(f"""WITH l AS ({LOG_SQL}), f AS (SELECT CAST(year(l_shipdate) AS INT) AS year, count(DISTINCT l_suppkey) AS n_files FROM lineitem GROUP BY 1),
r AS (SELECT CASE WHEN n_nationkey = 24 THEN 'skipped' WHEN n_nationkey % 2 = 1 OR n_nationkey = 7 THEN 'repaired' ELSE 'valid' END AS status FROM nation WHERE n_nationkey <> 23)
SELECT to_json({as_sql(METHOD)[:-1]}, 'region_count': (SELECT count(*) FROM r), 'processed_region_count': (SELECT count(*) FROM r WHERE status <> 'skipped'),
  'repaired_region_count': (SELECT count(*) FROM r WHERE status = 'repaired'), 'skipped_region_count': (SELECT count(*) FROM r WHERE status = 'skipped'),
  'number_of_input_files': (SELECT CAST(sum(n_files) AS BIGINT) FROM f), 'completed_years': (SELECT coalesce(list(year ORDER BY year) FILTER (WHERE error IS NULL), []) FROM l),
  'failed_years': (SELECT coalesce(list({{'year': year, 'error': error}} ORDER BY year) FILTER (WHERE error IS NOT NULL), []) FROM l),
  'source_files_by_year': (SELECT list({{'year': year, 'n_files': n_files}} ORDER BY year) FROM f), 'total_rows': (SELECT CAST(sum(rows) AS BIGINT) FROM l)}})::VARCHAR AS report""")
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is told about a run of years, its regions included."""
    lines = T.read_table(spark, sf_dir, "lineitem")
    files = lines.groupBy(F.year("l_shipdate").alias("year")).agg(F.countDistinct("l_suppkey").alias("n_files"))
    _, told = P.assess(regions(spark, sf_dir).where("country = 'home'"))
    return R.run_metadata(year_runs(spark, sf_dir)[1], files, told, METHOD)


@query("""SELECT ts AS time, (user_id % 10) * 0.25::DOUBLE AS latitude, (user_id // 10) * 0.25::DOUBLE AS longitude, value AS x FROM events""")
def normalised_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events under other names and with a dimension of one value."""
    events = T.read_table(spark, sf_dir, "events")
    other = events.select(F.col("ts").alias("valid_time"), (F.col("user_id") % 10 * F.lit(0.25)).alias("lat"), (F.floor(F.col("user_id") / 10) * F.lit(0.25)).alias("lon"), F.col("value").alias("v2"), F.lit(0).alias("number"))
    return series.normalised(other, "v1", "v2")


HOUR_SQL = "SELECT DISTINCT CAST(event_id % 2 AS INT) AS file, date_trunc('hour', ts) AS ts FROM events"


@query(f"""WITH p AS (SELECT file, CAST(year(ts) AS INT) AS year, ts, row_number() OVER (PARTITION BY file, year(ts) ORDER BY ts) - 1 AS k FROM ({HOUR_SQL}))
SELECT file, year, count(*) AS n, CAST(min(k) FILTER (WHERE ts <> make_timestamp(year, 1, 1, 0, 0, 0) + k * INTERVAL 1 HOUR) AS INT) AS first_wrong, CAST(dayofyear(make_date(year, 12, 31)) * 24 AS BIGINT) AS expected,
  count(*) FILTER (WHERE ts <> make_timestamp(year, 1, 1, 0, 0, 0) + k * INTERVAL 1 HOUR) = 0 AND count(*) = dayofyear(make_date(year, 12, 31)) * 24 AS exact FROM p GROUP BY 1, 2""")
def exact_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = T.read_table(spark, sf_dir, "events").select((F.col("event_id") % 2).cast("int").alias("file"), Q.hour(F.col("ts")).alias("ts")).distinct()
    return Q.exact_hours(hours, "file")


@query("""WITH s AS (SELECT o_orderkey // 1000 AS file, CASE WHEN o_orderkey % 501 <> 0 THEN o_orderdate END AS ts, lag(CASE WHEN o_orderkey % 501 <> 0 THEN o_orderdate END) OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) AS before FROM orders)
SELECT file, count(*) AS n, count(*) FILTER (WHERE ts IS NULL) AS n_missing, count(ts) - count(DISTINCT ts) AS n_repeated, count(*) FILTER (WHERE ts < before) AS n_disordered FROM s GROUP BY 1""")
def series_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.when(F.col("o_orderkey") % 501 != 0, F.col("o_orderdate"))
    orders = T.read_table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 1000).alias("file"), "o_orderkey", stamp.alias("ts"))
    return Q.series_faults(orders, "file", "o_orderkey", "ts")


@query("SELECT x AS c_mktsegment FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('SPACE'), ('TRAVEL')) v(x) WHERE x NOT IN (SELECT c_mktsegment FROM customer)")
def missing_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.missing_members(T.read_table(spark, sf_dir, "customer"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "SPACE", "TRAVEL"])


@query("""SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS ordinal FROM orders""")
def ordinals_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = T.read_table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey", "o_orderdate")
    return X.numbered(orders, "year", ["o_orderdate", "o_orderkey"]).select("year", "o_orderkey", F.col("ordinal").cast("long").alias("ordinal"))
