"""Queries over the given tables, and the same results as SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import frames as FR
from ..operators import grid as G
from ..operators import ledger as L
from ..operators import quality as Q
from ..operators import resample as R
from ..operators import weighted as W
from ..sources import files as X
from ..sources import gridded as GR
from ..sources import sinks as S
from ..sources import tables as T
from ..streaming import logs, tail, watch
from .registry import ORACLE_SQL, QUERIES, query, rounded  # noqa: F401

NOW = dt.date(2001, 11, 20)
LAG_DAYS = 5


# --- resampling and weighted statistics

DAILY_SQL = "SELECT user_id AS cell_id, CAST(ts AS DATE) AS day, min(value) AS x_min, max(value) AS x_max, round(avg(value), 6) AS x_mean FROM events GROUP BY 1, 2"


@query(DAILY_SQL, dates=("day",))
def daily_min_max_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.daily(T.field(spark, sf_dir), strict=False), "x_mean")


@query("""
SELECT user_id AS cell_id, CAST(ts AS DATE) AS day, CASE WHEN bool_or(event_id % 97 = 0) THEN NULL ELSE min(value) END AS x_min,
  CASE WHEN bool_or(event_id % 97 = 0) THEN NULL ELSE max(value) END AS x_max, CASE WHEN bool_or(event_id % 97 = 0) THEN NULL ELSE round(avg(value), 6) END AS x_mean
FROM events GROUP BY 1, 2""", dates=("day",))
def daily_strict_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.daily(gappy_field(spark, sf_dir)), "x_mean")


GAP = "event_id % 97 = 0"


def gappy_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field with missing values planted: a day with one of them is missing as a whole."""
    events = T.read_table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("cell_id"), "ts", F.when(F.expr(GAP), F.lit(float("nan"))).otherwise(F.col("value")).alias("x"))


def city_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city_id, city_name, city_area (more than that of the cells)."""
    sized = T.weights(spark, sf_dir).groupBy("city_id").agg((F.sum(F.abs("area")) + 1000).alias("city_area"))
    return T.cities(spark, sf_dir).join(sized, "city_id", "left")


VARIABLES = ("x_min", "x_max", "x_mean")
STRICT_SQL = ", ".join(f"CASE WHEN bool_or({GAP}) THEN NULL ELSE {e} END AS {v}" for v, e in zip(VARIABLES, ("min(value)", "max(value)", "round(avg(value), 6)")))


def city_daily_sql(least: int) -> str:
    parts, columns = [], []
    for v in VARIABLES:
        parts.append(f"""{v}_s AS (SELECT day, city_id, round(sum({v} * area) / sum(area), 6) AS {v}_mean, max({v}) AS {v}_max, min({v}) AS {v}_min,
  min({v}) FILTER (WHERE share >= 0.25) AS {v}_p25, min({v}) FILTER (WHERE share >= 0.75) AS {v}_p75, sum(area) AS {v}_held
  FROM (SELECT *, sum(area) OVER (PARTITION BY day, city_id ORDER BY {v} RANGE UNBOUNDED PRECEDING) / sum(area) OVER (PARTITION BY day, city_id) AS share
    FROM held WHERE {v} IS NOT NULL) GROUP BY 1, 2)""")
        columns.append(f"{v}_mean, {v}_max, {v}_min, {v}_p25, {v}_p75, round(coalesce({v}_held / total, 0), 6) AS {v}_valid_area_fraction")
    return f"""
WITH daily AS (SELECT user_id AS cell_id, CAST(ts AS DATE) AS day, {STRICT_SQL} FROM events GROUP BY 1, 2),
w AS (SELECT c_nationkey AS city_id, c_custkey AS cell_id, c_acctbal AS area FROM customer WHERE c_acctbal > {least}),
held AS (SELECT day, city_id, area, x_min, x_max, x_mean FROM daily JOIN w USING (cell_id)),
totals AS (SELECT city_id, count(*) AS n, sum(area) AS total FROM w GROUP BY 1),
areas AS (SELECT c_nationkey AS city_id, sum(abs(c_acctbal)) + 1000 AS city_area FROM customer GROUP BY 1),
days AS (SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS DATE) AS day FROM events),
{', '.join(parts)}
SELECT day AS date_utc, n_nationkey AS city_id, n_name AS city_name, coalesce(n, 0) AS grid_overlap_count,
  round(coalesce(total / city_area, 0), 6) AS grid_coverage_fraction, {', '.join(columns)}
FROM days CROSS JOIN nation LEFT JOIN (SELECT * FROM totals JOIN areas USING (city_id)) t ON n_nationkey = t.city_id
LEFT JOIN x_min_s USING (day, city_id) LEFT JOIN x_max_s USING (day, city_id) LEFT JOIN x_mean_s USING (day, city_id)"""


def city_daily(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    field = gappy_field(spark, sf_dir)
    daily = rounded(R.daily(field), "x_mean")
    weights = T.weights(spark, sf_dir).where(F.col("area") > least)
    found = W.city_daily(daily, R.calendar(field), weights, city_table(spark, sf_dir), list(VARIABLES))
    return rounded(found, "grid_coverage_fraction", *[f"{v}_{s}" for v in VARIABLES for s in ("mean", "valid_area_fraction")])


@query(city_daily_sql(0), dates=("date_utc",))
def city_daily_weighted_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return city_daily(spark, sf_dir, 0)


@query(city_daily_sql(8000), dates=("date_utc",))
def city_daily_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return city_daily(spark, sf_dir, 8000)


@query(city_daily_sql(0), dates=("date_utc",))
def city_daily_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from whole days: weights as sparse arrays, gathered by index, no shuffle of day and cell."""
    found = FR.city_daily(gappy_field(spark, sf_dir), T.weights(spark, sf_dir), city_table(spark, sf_dir), places=6)
    return rounded(found, "grid_coverage_fraction", *[f"{v}_{s}" for v in VARIABLES for s in ("mean", "valid_area_fraction")])


GRID_SINCE = "2024-01-16 00:00:00"


@query(f"""SELECT user_id AS cell_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, round(avg(value), 6) AS x FROM events WHERE ts >= TIMESTAMP '{GRID_SINCE}' AND ts < TIMESTAMP '{GRID_SINCE}' + INTERVAL 7 DAY GROUP BY 1, 2""")
def gridded_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field as hourly grids in a file a day, and a week of it read back: only the chunks of its hours are opened."""
    hourly = T.field(spark, sf_dir).groupBy("cell_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("x").alias("x"))
    rows = 1 + hourly.agg(F.coalesce(F.floor(F.max("cell_id") / 100), F.lit(0))).first()[0]
    frames = GR.frames_of(hourly, rows * 100).withColumn("path", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(".nc")))
    folder = T.shared_path(spark, "gridded")
    GR.write_gridded(frames, folder, "x", [i * G.STEP for i in range(rows)], [i * G.STEP for i in range(100)])
    since = dt.datetime.fromisoformat(GRID_SINCE)
    week = GR.read_gridded(spark, folder, "x").where((F.col("ts") >= since) & (F.col("ts") < since + dt.timedelta(days=7)))
    return GR.cells_of(week).select("cell_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("hour"), F.round("x", 6).alias("x"))


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def weighted_mean_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(W.mean("l_extendedprice", "l_quantity"), 6).alias("mean"))


QUANTILE_SQL = """SELECT l_suppkey, min(x) FILTER (WHERE share >= 0.25) AS p25, min(x) FILTER (WHERE share >= 0.75) AS p75 FROM (
  SELECT l_suppkey, {x} AS x, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY {x} RANGE UNBOUNDED PRECEDING) / sum(l_quantity) OVER (PARTITION BY l_suppkey) AS share FROM lineitem WHERE l_quantity > 0) GROUP BY 1"""


@query(QUANTILE_SQL.format(x="l_extendedprice"))
def weighted_quantiles_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.statistics(T.read_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity").select("l_suppkey", "p25", "p75")


@query(QUANTILE_SQL.format(x="l_discount"))
def weighted_quantiles_hof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.quantiles_by_array(T.read_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity")


@query("SELECT a.l_suppkey, a.p25 AS l_extendedprice_p25, a.p75 AS l_extendedprice_p75, b.p25 AS l_discount_p25, b.p75 AS l_discount_p75, c.p25 AS l_tax_p25, c.p75 AS l_tax_p75 FROM " + " ".join(f"{'JOIN' if n != 'a' else ''} ({QUANTILE_SQL.format(x=x)}) {n} {'USING (l_suppkey)' if n != 'a' else ''}" for n, x in zip("abc", ("l_extendedprice", "l_discount", "l_tax"))))
def weighted_quantiles_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_extendedprice", "l_discount", "l_tax"]
    found = W.statistics_of_many(T.read_table(spark, sf_dir, "lineitem"), ["l_suppkey"], names, "l_quantity")
    return found.select("l_suppkey", *[f"{v}_{p}" for v in names for p in ("p25", "p75")])


@query("""SELECT l_returnflag, l_linestatus, max(l_extendedprice) AS max, min(l_extendedprice) AS min FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2""")
def spatial_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.extremes(T.read_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity")


@query("""WITH seen AS (SELECT DISTINCT user_id FROM events WHERE value > 100)
SELECT c_nationkey AS city_id, round(coalesce(sum(c_acctbal) FILTER (WHERE user_id IS NOT NULL AND c_acctbal > 0) / sum(c_acctbal) FILTER (WHERE c_acctbal > 0), 0), 6) AS valid_area_fraction
FROM customer LEFT JOIN seen ON c_custkey = user_id GROUP BY 1""")
def valid_area_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = T.field(spark, sf_dir).where("x > 100").groupBy("cell_id").agg(F.max("x").alias("x"))
    return T.weights(spark, sf_dir).join(seen, "cell_id", "left").groupBy("city_id").agg(F.round(W.valid_share("x", "area"), 6).alias("valid_area_fraction"))


@query("""SELECT n_nationkey AS city_id, coalesce(count(c_custkey) FILTER (WHERE c_acctbal > 0), 0) AS grid_overlap_count, round(coalesce(sum(c_acctbal) FILTER (WHERE c_acctbal > 0) / (sum(abs(c_acctbal)) + 1000), 0), 6) AS grid_coverage_fraction
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def overlap_count_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.coverage(T.weights(spark, sf_dir), city_table(spark, sf_dir).drop("city_name")), "grid_coverage_fraction")


# --- units and coordinates

@query("SELECT event_id, round(CASE WHEN event_type IN ('click', 'view') THEN value - 273.15 ELSE value END, 6) AS celsius FROM events")
def kelvin_to_celsius(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("event_type").isin("click", "view"), " Kelvin ").otherwise("degC")
    return T.read_table(spark, sf_dir, "events").select("event_id", F.round(V.to_celsius(F.col("value"), unit), 6).alias("celsius"))


#: Customers as points: latitude and longitude follow from the key.
POINT_SQL = "SELECT c_custkey, c_nationkey, (c_custkey * 7 % 721) * 0.25 - 90 AS lat, ((c_custkey * 13 % 1440) * 0.25 + 180.0) % 360.0 - 180 AS lon FROM customer"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return T.read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", ((key * 7 % 721) * 0.25 - 90).alias("lat"), V.wrap_longitude((key * 13 % 1440) * F.lit(0.25)).alias("lon"))


@query(f"SELECT c_custkey, CAST(lon AS DOUBLE) AS lon FROM ({POINT_SQL})")
def longitude_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("c_custkey", "lon")


@query(f"SELECT c_custkey, CAST(round((lat + 90) / 0.25) * 1440 + round((lon + 180) / 0.25) AS BIGINT) AS cell_id FROM ({POINT_SQL})")
def flat_cell_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    iy, ix = F.round((F.col("lat") + 90) / 0.25), F.round((F.col("lon") + 180) / 0.25)
    return points(spark, sf_dir).select("c_custkey", G.flat_id(iy, ix, 1440).cast("bigint").alias("cell_id"))


TILE_SQL = """SELECT printf('G%04d', r * 36 + c + 1) AS grid_id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(90 - r * 10 AS INT) AS north, CAST(80 - r * 10 AS INT) AS south, CAST(c * 10 - 180 AS INT) AS west, CAST(c * 10 - 170 AS INT) AS east,
  CAST(90 - r * 10 AS DOUBLE) AS request_north, CASE WHEN r = 17 THEN -90.0::DOUBLE ELSE round(80 - r * 10 + 0.1, 1)::DOUBLE END AS request_south, CAST(c * 10 - 180 AS DOUBLE) AS request_west, round(c * 10 - 170 - 0.1, 1)::DOUBLE AS request_east
FROM range(18) a(r) CROSS JOIN range(36) b(c)"""
TILE_OF_SQL = "printf('G%04d', CAST(least(17, greatest(0, floor((90 - lat) / 10))) * 36 + floor((lon + 180) / 10) + 1 AS BIGINT))"


@query(f"WITH tile AS ({TILE_SQL}), p AS (SELECT {TILE_OF_SQL} AS grid_id, count(*) AS n_points FROM ({POINT_SQL}) GROUP BY 1) SELECT tile.*, coalesce(n_points, 0) AS n_points FROM tile LEFT JOIN p USING (grid_id)")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = points(spark, sf_dir).groupBy(G.tile_of(F.col("lat"), F.col("lon")).alias("grid_id")).agg(F.count("*").alias("n_points"))
    return F.broadcast(G.tiles(spark)).join(held, "grid_id", "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))


# --- bounding boxes and areas: nations as boxes around their customers' points

BOX_SQL = f"SELECT c_nationkey AS city_id, min(lon) / 40 + 100 AS xmin, max(lon) / 40 + 102 AS xmax, min(lat) / 40 + 30 AS ymin, max(lat) / 40 + 31 AS ymax FROM ({POINT_SQL}) GROUP BY 1"
CELL_SQL = "SELECT iy, ix, 20 + iy * 0.25::DOUBLE AS lat, 90 + ix * 0.25::DOUBLE AS lon FROM range(80) a(iy) CROSS JOIN range(120) b(ix)"
HIT_SQL = "lat + 0.125 > ymin AND lat - 0.125 < ymax AND lon + 0.125 > xmin AND lon - 0.125 < xmax"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy(F.col("c_nationkey").alias("city_id")).agg((F.min("lon") / 40 + 100).alias("xmin"), (F.max("lon") / 40 + 102).alias("xmax"), (F.min("lat") / 40 + 30).alias("ymin"), (F.max("lat") / 40 + 31).alias("ymax"))


CANDIDATE_SQL = f"SELECT city_id, lat, lon FROM ({BOX_SQL}) JOIN ({CELL_SQL}) ON {HIT_SQL}"


@query(CANDIDATE_SQL)
def bbox_candidates_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.range(80 * 120).select((20 + F.floor(F.col("id") / 120) * 0.25).cast("double").alias("lat"), (90 + (F.col("id") % 120) * 0.25).cast("double").alias("lon"))
    return G.cells_by_predicate(boxes(spark, sf_dir), cells).select("city_id", "lat", "lon")


@query(CANDIDATE_SQL)
def bbox_candidates_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cells_by_arithmetic(boxes(spark, sf_dir), 20.0, 90.0, 80, 120).select("city_id", "lat", "lon")


E2 = G.ECCENTRICITY2
Q_SQL = lambda a: f"({1 - E2} * (sin(radians({a})) / (1 - {E2} * sin(radians({a})) ** 2) - ln((1 - sqrt({E2}) * sin(radians({a}))) / (1 + sqrt({E2}) * sin(radians({a})))) / (2 * sqrt({E2}))))"


@query(f"""SELECT city_id, lat, lon, round({G.AXIS}::DOUBLE ** 2 / 2 * radians(e - w) * ({Q_SQL('n')} - {Q_SQL('s')}) / 1e6, 4) AS area_km2
FROM (SELECT city_id, lat, lon, greatest(ymin, lat - 0.125) AS s, least(ymax, lat + 0.125) AS n, greatest(xmin, lon - 0.125) AS w, least(xmax, lon + 0.125) AS e FROM ({BOX_SQL}) JOIN ({CELL_SQL}) ON {HIT_SQL}) WHERE n > s AND e > w""")
def cell_overlap_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = G.cells_by_arithmetic(boxes(spark, sf_dir), 20.0, 90.0, 80, 120)
    return G.cell_overlaps(cells).select("city_id", "lat", "lon", F.round(F.col("area_m2") / 1e6, 4).alias("area_km2"))


@query(f"""WITH c AS (SELECT city_id, greatest(ymin, lat - 0.125) AS s, least(ymax, lat + 0.125) AS n, greatest(xmin, lon - 0.125) AS w, least(xmax, lon + 0.125) AS e FROM ({BOX_SQL}) JOIN ({CELL_SQL}) ON {HIT_SQL})
SELECT city_id, count(*) AS n_cells, round(sum({G.AXIS}::DOUBLE ** 2 / 2 * radians(e - w) * ({Q_SQL('n')} - {Q_SQL('s')})) / 1e6, 3) AS area_km2 FROM c GROUP BY 1""")
def polygon_clip_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rings = G.cells_by_arithmetic(boxes(spark, sf_dir), 20.0, 90.0, 80, 120).withColumn("ring", F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax")))
    return G.clip_to_cell(rings).groupBy("city_id").agg(F.count("*").alias("n_cells"), F.round(F.sum("area_m2") / 1e6, 3).alias("area_km2"))


@query("SELECT city_id, n, CAST(coalesce(sum(n) OVER (ORDER BY city_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT n_nationkey AS city_id, count(c_custkey) FILTER (WHERE c_acctbal > 0) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)")
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = T.cities(spark, sf_dir).select("city_id", F.lit(1.0).alias("city_area"))
    return L.offsets(W.coverage(T.weights(spark, sf_dir), totals).select("city_id", F.col("grid_overlap_count").alias("n")), "city_id", "n")


# --- completeness and order

@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n_rows, count(DISTINCT hour(ts)) AS n_hours, count(DISTINCT hour(ts)) = 24 AS complete FROM events GROUP BY 1", dates=("day",))
def hourly_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.hourly_completeness(T.read_table(spark, sf_dir, "events"))


@query("""SELECT event_type, h AS hour FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS h FROM events)
EXCEPT SELECT event_type, date_trunc('hour', ts) FROM events""")
def missing_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.missing_hours(T.read_table(spark, sf_dir, "events"), "event_type")


@query("""WITH d AS (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS year, CAST(l_shipdate AS DATE) AS found FROM lineitem), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY found) AS INT) AS position FROM d),
e AS (SELECT *, CAST(make_date(year, 1, 1) + (position - 1) AS DATE) AS expected FROM r)
SELECT year, position, expected, found FROM e WHERE expected <> found QUALIFY row_number() OVER (PARTITION BY year ORDER BY position) = 1""", dates=("expected", "found"))
def first_sequence_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.first_mismatch(T.read_table(spark, sf_dir, "lineitem"), "l_shipdate")


@query("""SELECT CAST(year(l_shipdate) AS INT) AS year, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_days, CAST(dayofyear(make_date(year(l_shipdate), 12, 31)) AS BIGINT) AS expected_days,
  count(DISTINCT CAST(l_shipdate AS DATE)) = dayofyear(make_date(year(l_shipdate), 12, 31)) AS complete FROM lineitem GROUP BY year(l_shipdate)""")
def year_completeness_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.year_days(T.read_table(spark, sf_dir, "lineitem"), "l_shipdate")


@query("SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5")
def duplicate_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicates(T.read_table(spark, sf_dir, "lineitem"), "l_shipdate", 5)


@query("SELECT * FROM (SELECT o_orderkey // 1000 AS file, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) AS before FROM orders) WHERE o_orderdate <= before")
def monotonic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = T.read_table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 1000).alias("file"), "o_orderkey", "o_orderdate")
    return Q.order_violations(orders, "file", "o_orderkey", "o_orderdate")


@query(f"""WITH d AS (SELECT DISTINCT c_nationkey, CAST(lon AS DOUBLE) AS lon FROM ({POINT_SQL})), s AS (SELECT c_nationkey, abs(lon - lag(lon) OVER (PARTITION BY c_nationkey ORDER BY lon)) AS step FROM d)
SELECT c_nationkey, count(*) AS n, min(step) AS least, max(step) AS greatest, count(*) FILTER (WHERE abs(step - 0.25) > 1e-6) AS wrong FROM s GROUP BY 1""")
def grid_spacing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.spacing(points(spark, sf_dir), "c_nationkey", "lon", 0.25)


#: Latitudes of seven files: those of odd numbers are the other way round, that of number 4 lacks the last.
GRID_SQL = """SELECT f AS file, p AS place, CASE WHEN f % 2 = 1 THEN lats[n - p] ELSE lats[p + 1] END AS lat
FROM (SELECT list_sort(list(DISTINCT c_custkey % 50 * 0.25::DOUBLE)) AS lats, len(list(DISTINCT c_custkey % 50)) AS n FROM customer) CROSS JOIN range(7) a(f) CROSS JOIN range(50) b(p)
WHERE p < n AND NOT (f = 4 AND p = n - 1)"""


def file_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lats = T.read_table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50 * F.lit(0.25)).alias("lat")).distinct()
    listed = lats.agg(F.array_sort(F.collect_set("lat")).alias("lats")).select("lats", F.explode(F.expr("sequence(0L, 6L)")).alias("file"))
    turned = F.when(F.col("file") % 2 == 1, F.reverse("lats")).when(F.col("file") == 4, F.slice("lats", 1, F.greatest(F.size("lats") - 1, F.lit(0)))).otherwise(F.col("lats"))
    return listed.select("file", F.posexplode(turned).alias("place", "lat")).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH g AS ({GRID_SQL}), r AS (SELECT place, lat AS wanted FROM g WHERE file = 0)
SELECT file, count(*) AS n, bool_and(coalesce(lat = wanted, false)) AND count(*) = (SELECT count(*) FROM r) AS same_as_reference FROM g LEFT JOIN r USING (place) GROUP BY 1""")
def grid_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.grids_that_differ(file_grids(spark, sf_dir), "file", "place", "lat")


@query(f"""WITH g AS (SELECT DISTINCT file, lat FROM ({GRID_SQL}) WHERE file > 0 OR lat <> 0.5), s AS (SELECT file, lat - lag(lat) OVER (PARTITION BY file ORDER BY lat) AS step FROM g)
SELECT file, lat FROM g WHERE file = (SELECT min(file) FROM (SELECT file FROM s GROUP BY 1 HAVING count(*) > 1 AND coalesce(max(abs(step - 0.25)), 0) <= 1e-6))""")
def reference_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = file_grids(spark, sf_dir).where("file > 0 OR lat <> 0.5")  # the first file has a hole
    return Q.reference_grid(grids, "file", "lat", 0.25)


@query("SELECT DISTINCT l_suppkey AS file, CAST(year(l_shipdate) AS INT) AS year FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 1999")
def file_year_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.years_of_files(T.read_table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate", 1996, 1999)


@query("""WITH f AS (SELECT CAST(year(o_orderdate) AS INT) AS year, count(DISTINCT o_custkey) AS n_files FROM orders GROUP BY 1), y AS (SELECT CAST(unnest(generate_series(min(year) - 1, max(year) + 1)) AS INT) AS year FROM f)
SELECT year, coalesce(n_files, 0) AS n_files FROM y LEFT JOIN f USING (year)""")
def files_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = T.read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.year("o_orderdate").alias("year"))
    return X.files_by_year(index)


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def year_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.in_year(T.read_table(spark, sf_dir, "orders"), "o_orderdate", 1996).select("o_orderkey", "o_orderdate", "o_totalprice")


# --- planning and the ledger

def order_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, last (the last day with an order)."""
    return T.read_table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.max(F.col("o_orderdate").cast("date")).alias("last"))


YEARS_SQL = "SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(max(o_orderdate) AS DATE) AS last FROM orders GROUP BY 1"


@query(f"""WITH y AS ({YEARS_SQL}), t AS (SELECT DISTINCT {TILE_OF_SQL} AS grid_id FROM ({POINT_SQL}))
SELECT year || '_' || grid_id AS task_id, year, grid_id, printf('%04d', year) || '/' || grid_id || '.parquet' AS output_file FROM y CROSS JOIN t""")
def year_tile_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = points(spark, sf_dir).select(G.tile_of(F.col("lat"), F.col("lon")).alias("grid_id")).distinct()
    years = order_years(spark, sf_dir)
    tasks = held.join(T.small(years, 10_000), how="cross")  # years times tiles
    return tasks.select(F.concat_ws("_", F.col("year").cast("string"), "grid_id").alias("task_id"), "year", "grid_id", F.concat(F.format_string("%04d", "year"), F.lit("/"), "grid_id", F.lit(".parquet")).alias("output_file"))


@query(f"""WITH m AS (SELECT year, last, CAST(unnest(range(1, month(last) + 1)) AS INT) AS month FROM ({YEARS_SQL})), d AS (SELECT year, month, CAST(CASE WHEN month = month(last) THEN day(last) ELSE day(last_day(make_date(year, month, 1))) END AS INT) AS last_day FROM m)
SELECT year, month, last_day, printf('month_%02d_days_01_%02d', month, last_day) AS chunk, list_aggregate(list_transform(range(1, last_day + 1), lambda x: printf('%02d', x)), 'string_agg', ',') AS days, list_aggregate(list_transform(range(0, 24), lambda x: printf('%02d:00', x)), 'string_agg', ',') AS times FROM d""")
def monthly_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.monthly_chunks(order_years(spark, sf_dir))


@query(f"SELECT year, last, (last - make_date(year, 1, 1) + 1) * 24 - CASE WHEN year = 1950 THEN 1 ELSE 0 END AS hours, CASE WHEN year < 2001 THEN make_date(year, 12, 31) WHEN year = 2001 THEN DATE '2001-11-15' END AS available FROM ({YEARS_SQL})", dates=("last", "available"))
def expected_hours_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = order_years(spark, sf_dir)
    return years.select("year", "last", L.expected_hours(F.col("year"), F.col("last")).cast("long").alias("hours"), L.last_available(F.col("year"), NOW, LAG_DAYS).alias("available"))


@query("SELECT s AS status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.status_counts(T.read_table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


SECONDS_SQL = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END"


@query(f"""SELECT event_type, count(*) AS n, round(coalesce(sum({SECONDS_SQL}) / 3600, 0), 3) AS hours, round(coalesce(avg({SECONDS_SQL}) / 60, 0), 3) AS mean_minutes
FROM events GROUP BY 1""")
def duration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return L.durations(T.read_table(spark, sf_dir, "events").withColumn("seconds", told), "event_type", "seconds")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS attempts FROM events GROUP BY 1")
def ledger_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest(T.read_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


STATE_SQL = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'partial' END"


def order_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("partial")
    return T.read_table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), status.alias("status"))


@query(f"""WITH t AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, {STATE_SQL} AS status FROM orders), f AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, CAST(max(l_shipdate) AS DATE) AS last_seen FROM lineitem GROUP BY 1)
SELECT o_orderkey, year, CASE WHEN n >= 2 AND year <= 1998 THEN CASE WHEN year < 1998 THEN 'completed' WHEN last_seen >= make_date(year, 12, 31) THEN 'completed' ELSE 'partial' END WHEN (n IS NOT NULL AND year <= 1998) OR status IN ('doing', 'completed', 'partial') THEN 'pending' ELSE status END AS status,
  CASE WHEN n < 2 AND year <= 1998 THEN 'file is not whole' WHEN (n IS NULL OR year > 1998) AND status IN ('doing', 'completed', 'partial') THEN 'file is missing' END AS error FROM t LEFT JOIN f USING (o_orderkey)""")
def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = T.read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max(F.col("l_shipdate").cast("date")).alias("last_seen"))
    return L.reconcile(order_tasks(spark, sf_dir), files, "o_orderkey", 1998, least_rows=2)


@query(f"SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, {STATE_SQL} AS status FROM orders WHERE o_orderstatus <> 'F' AND year(o_orderdate) <= 1998")
def candidate_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.candidates(order_tasks(spark, sf_dir), "o_orderkey", 1998)


@query(f"SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, {STATE_SQL} AS status FROM orders WHERE o_orderstatus <> 'F' AND year(o_orderdate) <= 1998 ORDER BY 2, 1 LIMIT 100")
def next_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred tasks that a run which is told to do no more would take up."""
    return L.candidates(order_tasks(spark, sf_dir), "o_orderkey", 1998, limit=100)


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS wanted FROM orders")
def grid_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = T.read_table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.grid_members(T.read_table(spark, sf_dir, "orders").select("o_orderkey"), wanted, "o_orderkey")


@query("""SELECT event_type, CAST(k AS INT) AS attempt, CAST(least(60, 5 * 2 ** k) AS BIGINT) AS seconds, n FROM (SELECT event_type, CAST(floor(value / 60) AS INT) AS k, count(*) AS n FROM events GROUP BY 1, 2)""")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = T.read_table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("value") / 60).cast("int").alias("attempt")).agg(F.count("*").alias("n"))
    return attempts.withColumn("seconds", L.backoff_seconds(F.col("attempt")))


# --- sets and merges

@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_extendedprice) = 1""")
def merge_dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    return L.keep_first(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_extendedprice"]).drop("l_shipdate")


@query("""SELECT CAST(year(t) AS INT) AS year, count(*) AS n, round(sum(price), 2) AS total
FROM (SELECT o_orderdate AS t, o_totalprice AS price FROM orders UNION ALL SELECT l_shipdate, l_extendedprice FROM lineitem) GROUP BY 1""")
def yearly_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = T.read_table(spark, sf_dir, "orders"), T.read_table(spark, sf_dir, "lineitem")
    parts = [orders.select(F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price")), lines.select(F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("price"))]
    return parts[0].unionByName(parts[1]).groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("SELECT o_custkey AS key FROM orders WHERE o_totalprice > 200000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def column_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.read_table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("key"))
    return a.union(T.read_table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")).subtract(T.read_table(spark, sf_dir, "lineitem").select("l_orderkey"))


# --- logs and streams

LINE_SQL = "SELECT CAST(ts AS DATE) AS day, event_id AS n, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ': ' || event_id AS line FROM events"
ALERT_SQL = r"regexp_matches(line, '(?i)(^|\s)(ERROR|CRITICAL)(\s|:)|Traceback \(most recent call last\)|[A-Za-z]+Error:')"


@query(f"SELECT * FROM ({LINE_SQL}) WHERE {ALERT_SQL}", dates=("day",))
def log_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.alerts(T.log_lines(T.read_table(spark, sf_dir, "events")))


CONTEXT_SQL = f"""SELECT day, n, line, is_alert FROM (SELECT *, bool_or(is_alert) OVER (PARTITION BY day ORDER BY n ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near
  FROM (SELECT *, {ALERT_SQL} AS is_alert FROM ({LINE_SQL}))) WHERE near"""


@query(CONTEXT_SQL, dates=("day",))
def log_alert_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.alerts_with_context(T.log_lines(T.read_table(spark, sf_dir, "events")))


CLOSED_SQL = "day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


@query(f"SELECT * FROM ({DAILY_SQL}) WHERE {CLOSED_SQL}", dates=("day",))
def stream_daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(logs.stream_daily(spark, sf_dir), "x_mean")


@query(f"SELECT * FROM ({LINE_SQL}) WHERE {ALERT_SQL}", dates=("day",))
def stream_log_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.stream_alerts(spark, sf_dir)


@query("""WITH o AS (SELECT (user_id % 8)::VARCHAR AS key, ts, event_id % 1000 AS size FROM events), s AS (SELECT key, min(ts) AS first, max(size) AS size FROM o GROUP BY 1)
SELECT key, 'new output' AS notice, NULL::VARCHAR AS "at", size FROM s WHERE size > 0
UNION ALL SELECT key, 'periodic', strftime(moment, '%Y-%m-%d %H:%M:%S.%f'), size FROM (SELECT key, size, unnest(generate_series(date_trunc('milliseconds', first) + INTERVAL 12 HOUR, (SELECT max(ts) - INTERVAL 10 MINUTE FROM o), INTERVAL 12 HOUR)) AS moment FROM s)""")
def watched_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices about eight growing outputs: new output, and one every twelve hours, from keyed state and timers."""
    events = logs.event_stream(spark, sf_dir)
    found = watch.watched(events.select((F.col("user_id") % 8).alias("key"), "ts", (F.col("event_id") % 1000).alias("size")))
    return found.select("key", "notice", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "size")


@query(f"SELECT strftime(day, '%Y-%m-%d') AS log, count(*) AS n_alerts, min(line) AS least, max(line) AS greatest FROM ({LINE_SQL}) WHERE {ALERT_SQL} GROUP BY day")
def tailed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of each day as a text file, tailed: alerts among the lines that it has gained."""
    folder = T.shared_path(spark, "logs")
    lines = T.log_lines(T.read_table(spark, sf_dir, "events"))
    lines.repartition("day").sortWithinPartitions("day", "n").select("day", "line").write.partitionBy("day").text(folder)
    found = logs.drained(logs.alerts(tail.tail(spark, folder, r".*\.txt")))
    return found.groupBy(F.regexp_extract("path", "day=([^/]+)/", 1).alias("log")).agg(F.count("*").alias("n_alerts"), F.min("line").alias("least"), F.max("line").alias("greatest"))


@query(CONTEXT_SQL, dates=("day",))
def stream_alert_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.stream_context(spark, sf_dir)


# --- reports and sinks

@query("""SELECT to_json({'city_count': count(DISTINCT c_nationkey), 'cell_count': count(*), 'skipped_cell_count': count(*) FILTER (WHERE c_acctbal <= 0),
  'cities_with_skipped_cells': coalesce(list_sort(list(DISTINCT c_nationkey) FILTER (WHERE c_acctbal <= 0)), [])})::VARCHAR AS report FROM customer""")
def qc_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = T.weights(spark, sf_dir)
    bad = F.col("area") <= 0
    # at most one entry per city
    return S.json_report(cells, city_count=F.countDistinct("city_id"), cell_count=F.count("*"), skipped_cell_count=F.count_if(bad), cities_with_skipped_cells=F.array_sort(F.collect_set(F.when(bad, F.col("city_id")))))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, count(DISTINCT {c}) AS n_distinct, min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest FROM events""" for c in ("event_id", "user_id", "event_type", "props")))
def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.profile(T.read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props"))


def inspection_sql(table: str, **kinds: str) -> str:
    texts = {"number": "NULL::VARCHAR", "time": "strftime({0}(\"{1}\"), '%Y-%m-%d %H:%M:%S.%f')", "text": "{0}(\"{1}\")"}
    numbers = lambda f, c, kind: f'{f}("{c}")::DOUBLE' if kind == "number" else "NULL::DOUBLE"
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS "table", '{c}' AS "column", '{kind}' AS kind, count("{c}") AS n, count(*) - count("{c}") AS n_null, {numbers('min', c, kind)} AS least_number, {numbers('max', c, kind)} AS greatest_number,
  round({numbers('avg', c, kind)}, 6) AS mean, {texts[kind].format('min', c)} AS least_text, {texts[kind].format('max', c)} AS greatest_text FROM {table}"""
        for c, kind in kinds.items()
    )


EVENT_KINDS = dict(event_id="number", ts="time", user_id="number", event_type="text", value="number", props="text")
LINE_KINDS = dict.fromkeys(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), "number") | dict(l_returnflag="text", l_linestatus="text", l_shipdate="time")


@query(f"{inspection_sql('events', **EVENT_KINDS)} UNION ALL {inspection_sql('lineitem', **LINE_KINDS)}")
def table_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each column of the events and of the lines holds."""
    told = [S.inspect(T.read_table(spark, sf_dir, t).select(*kinds)).select(F.lit(t).alias("table"), "*") for t, kinds in (("events", EVENT_KINDS), ("lineitem", LINE_KINDS))]
    return rounded(told[0].unionByName(told[1]), "mean")


@query(city_daily_sql(0), dates=("date_utc",))
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The city-day output in order of day and city, as yearly CSV folders, combined into one and read back."""
    found = city_daily(spark, sf_dir, 0)
    years, combined = (T.shared_path(spark, f"city-daily-{x}") for x in ("years", "combined"))
    S.write_csv(found.withColumn("year", F.year("date_utc")), years, ["date_utc", "city_id"], by="year")
    return S.combine_csv(found, years, combined, ["date_utc", "city_id"])
